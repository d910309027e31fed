"""Product rows from stored pages: one pass, no shuffle."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.text import strip
from ..sources.session import ship
from .images import candidate_urls

#: Marks of pages that ask for verification, of the product and of the image reader.
PRODUCT_MARKS = ["type the characters you see in this image", "enter the characters you see below", "sorry, we just need to make sure you're not a robot", "api-services-support@amazon.com"]
IMAGE_MARKS = ["captcha", "enter the characters you see below", "/errors/validatecaptcha", "type the characters you see in this image"]
#: Containers of detail images and classes of comparison blocks.
DETAIL_IDS = {"aplus_feature_div", "aplus", "aplus3p_feature_div"}
COMPARISON = {"comparison-table", "comparison-table-scroller"}

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


def needs_verification(html: Column, marks: list[str] = PRODUCT_MARKS) -> Column:
    low = F.lower(html)
    return F.exists(F.array(*map(F.lit, marks)), lambda m: F.contains(low, m))


#: An element as the helper gives it: what it is, its number, the last number inside it, its parent's; for a table header
#: the first cell beside it; the range of its texts; for an image the link about it; whether a comparison block is about it.
_NAMES = {"id": "id", "src": "src", "data-src": "data_src", "href": "href", "title": "title", "lang": "lang", "data-hook": "hook", "data-a-color": "color"}
ELEMENT = (
    "struct<tag: string, classes: array<string>, " + "".join(f"{x}: string, " for x in _NAMES.values())
    + "n: int, last: int, parent: int, cell: int, t0: int, t1: int, link: string, compared: boolean>"
)
FLAT = f"struct<texts: array<string>, elements: array<{ELEMENT}>, problem: string>"


class _Flat(HTMLParser):
    """One pass over a page: its texts, without those of scripts and styles, and its elements as rows."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.texts: list[str] = []
        self.rows: list[list] = []
        self.open: list[int] = []
        self.names: Counter[str] = Counter()  # of the open elements
        self.cells: dict[int, int] = {}
        self.links: list[str] = []
        self.compared = self.silent = 0
        self.start("", [], True)  # the page itself

    def start(self, tag: str, attrs: list[tuple[str, str | None]], inside: bool) -> None:
        had = {k: v or "" for k, v in attrs}
        n, parent, classes = len(self.rows), self.open[-1] if self.open else -1, had.get("class", "").split()
        if tag == "td" and parent >= 0:
            self.cells.setdefault(parent, n)
        link = self.links[-1] if tag == "img" and self.links else None
        self.rows.append([tag, classes, *map(had.get, _NAMES), n, n, parent, None, len(self.texts), len(self.texts), link, self.compared > 0])
        if inside:
            self.open.append(n)
            self.count(n, 1)

    def count(self, n: int, by: int) -> None:
        tag, classes, href = self.rows[n][0], self.rows[n][1], self.rows[n][5]
        self.names[tag] += by
        self.compared += by * bool(COMPARISON.intersection(classes))
        self.silent += by * (tag in ("script", "style"))
        if tag == "a" and href is not None:
            self.links.append(href) if by > 0 else self.links.pop()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.start(tag, attrs, tag not in _VOID)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.start(tag, attrs, False)

    def shut(self) -> str:
        n = self.open.pop()
        self.count(n, -1)
        self.rows[n][_LAST], self.rows[n][_T1] = len(self.rows) - 1, len(self.texts)
        return self.rows[n][0]

    def handle_endtag(self, tag: str) -> None:
        while self.names[tag] and self.shut() != tag:
            pass

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.texts.append(data)

    def done(self) -> tuple[list[str], list[list]]:
        self.close()
        self.handle_endtag("")
        for row in self.rows:
            if row[0] == "th":
                row[_CELL] = self.cells.get(row[_PARENT])
        return self.texts, self.rows


_N, _LAST, _PARENT, _CELL, _T0, _T1 = range(2 + len(_NAMES), 8 + len(_NAMES))


def flatten(html: str) -> tuple[list[str], list[list]]:
    """Texts and elements of a page, in time linear in its length however it is nested."""
    flat = _Flat()
    flat.feed(html)
    return flat.done()


def _flat(html: Iterator[pa.Array]) -> Iterator[pa.Array]:
    kinds = [pa.string(), pa.list_(pa.string()), *[pa.string()] * len(_NAMES), *[pa.int32()] * 6, pa.string(), pa.bool_()]
    names = ["tag", "classes", *_NAMES.values(), "n", "last", "parent", "cell", "t0", "t1", "link", "compared"]
    for batch in html:
        texts, rows, ends, problems = [], [], [0], []
        for page in batch.to_pylist():
            try:
                own, found, problem = *flatten(page or ""), None
            except (ValueError, AssertionError) as e:
                own, found, problem = [], [], str(e)[:200]
            texts.append(own)
            rows += found
            ends.append(len(rows))
            problems.append(problem)
        columns = list(zip(*rows)) if rows else [()] * len(kinds)
        elements = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), elements)
        yield pa.StructArray.from_arrays([pa.array(texts, pa.list_(pa.string())), lists, pa.array(problems, pa.string())], ["texts", "elements", "problem"])


# Rules on elements, as column expressions. A missing element is null, and so is what is taken from it.

_TEXTS, _ELEMENTS = "__flat.texts", "__flat.elements"


def _first(elements: Column | str, rule: Callable[[Column], Column]) -> Column:
    return F.get(F.filter(elements, rule), F.lit(0))


def _inside(e: Column, rule: Callable[[Column], Column]) -> Column:
    """The elements inside e for which the rule holds: they lie beside each other."""
    return F.filter(F.slice(_ELEMENTS, e["n"] + 2, e["last"] - e["n"]), rule)


def _is(tag: str | None = None, cls: str | None = None, **values: str) -> Callable[[Column], Column]:
    def rule(x: Column) -> Column:
        out = F.lit(True) if tag is None else x["tag"] == tag
        if cls is not None:
            out = out & F.array_contains(x["classes"], cls)
        for field, value in values.items():
            out = out & F.coalesce(x[field] == value, F.lit(False))
        return out

    return rule


def _pieces(e: Column) -> Column:
    return F.slice(_TEXTS, e["t0"] + 1, e["t1"] - e["t0"])


def _text(e: Column) -> Column:
    return strip(F.array_join(_pieces(e), ""))


def _spaced(e: Column) -> Column:
    """The texts of an element, each stripped, with a space between two."""
    return F.array_join(F.filter(F.slice("__stripped", e["t0"] + 1, e["t1"] - e["t0"]), lambda t: t != ""), " ")


def _said(*elements: Column) -> Column:
    """The first text there is."""
    return F.coalesce(*[F.nullif(_text(e), F.lit("")) for e in elements])


def _cell(name: str) -> Column:
    """The cell beside the table header that holds a name."""
    header = _first("__ths", lambda x: x["cell"].isNotNull() & _text(x).rlike(f"(?iu){name}"))
    return F.get(F.col(_ELEMENTS), header["cell"])


def _filled(array: Column) -> Column:
    """The array, null if it has no entry."""
    return F.when(F.size(array) > 0, array)


def _detail_images() -> Column:
    """Images of the detail sections (of the page if it has none), but for comparison blocks and links to other products."""
    boxes = F.filter(_ELEMENTS, lambda x: F.coalesce(x["id"].isin(*DETAIL_IDS), F.lit(False)))
    # outermost sections only: they lie one after another, so what is in them is in order
    outer = F.aggregate(
        boxes, F.expr("struct(cast(array() as array<struct<n: int, last: int>>) as kept, -1 as last)"),
        lambda s, b: F.when(b["n"] <= s["last"], s).otherwise(F.struct(F.concat(s["kept"], F.array(F.struct(b["n"].alias("n"), b["last"].alias("last")))).alias("kept"), b["last"].alias("last"))),
        lambda s: s["kept"],
    )
    images = lambda b: F.filter(F.slice(_ELEMENTS, b["n"] + 2, b["last"] - b["n"]), lambda x: x["tag"] == "img")
    found = F.coalesce(_filled(F.flatten(F.transform(outer, images))), F.when(F.size(outer) == 0, F.col("__imgs")), F.array().cast(f"array<{ELEMENT}>"))
    to = lambda x: F.regexp_extract(x["link"], r"(?i)/dp/([A-Z0-9]{10})", 1)
    other = lambda x: F.coalesce((to(x) != "") & (F.col("asin") != "") & (F.upper(to(x)) != F.upper("asin")), F.lit(False))
    sources = F.transform(F.filter(found, lambda x: ~x["compared"] & ~other(x)), lambda x: strip(F.coalesce(F.nullif(x["src"], F.lit("")), x["data_src"], F.lit(""))))
    whole = F.transform(F.filter(sources, lambda u: F.contains(u, F.lit(urls.DETAIL_TOKEN))), lambda u: F.when(F.startswith(u, F.lit("//")), F.concat(F.lit("https:"), u)).otherwise(u))
    return F.array_distinct(F.filter(whole, lambda u: F.startswith(u, F.lit("https://"))))


def _with_elements(pages: DataFrame) -> DataFrame:
    """Elements by tag, and those that several fields are taken from."""
    tagged = {f"__{t}s": F.filter(_ELEMENTS, _is(t)) for t in ("span", "li", "th", "a", "img", "ul", "div", "h1", "p")}
    pages = pages.withColumn("__flat", F.arrow_udf(_flat, FLAT)(F.col("html"))).withColumns({"__stripped": F.transform(_TEXTS, strip), **tagged})
    core = _first("__divs", _is(id="corePriceDisplay_desktop_feature_div"))
    return pages.withColumns({
        "__core": F.when(core.isNotNull(), _inside(core, _is("span"))), "__seller": _cell("Best Sellers Rank|亚马逊热销商品排名"),
        "__items": F.filter(F.transform("__lis", _spaced), lambda t: F.contains(t, F.lit("#"))), "__swatches": F.filter("__lis", _is(cls="swatchElement")),
        "__panel": F.transform(F.filter("__ps", _is(cls="bsr-list-item")), lambda p: F.concat(
            F.coalesce(_said(F.get(_inside(p, _is("span", "rank-box")), F.lit(0))), F.lit("None")), F.lit(" in "), F.coalesce(_said(F.get(_inside(p, _is("span", "exts-color-blue")), F.lit(0))), F.lit("None")))),
    })


def _fields() -> dict[str, Column]:
    """Texts of a page's fields; numbers are taken from them later."""
    core, spans = F.col("__core"), F.col("__spans")
    span = lambda **v: _first(spans, _is(**v))
    label = _text(_first(core, lambda x: F.contains(x["id"], F.lit("apex-pricetopay-accessibility-label"))))
    paid = F.when(label.rlike("[$€£￥元]"), label).otherwise(F.nullif(F.regexp_extract(label, r"([\d.,]+)", 1), F.lit("")))
    whole, fraction = _said(_first(core, _is(cls="a-price-whole"))), _said(_first(core, _is(cls="a-price-fraction")))
    deal = span(id="priceblock_dealprice")
    shown = _first(core, lambda x: F.array_contains(x["classes"], "a-price") & ~F.array_contains(x["classes"], "a-text-price"))
    swatches = F.col("__swatches")
    selected = F.coalesce(_first(swatches, lambda x: F.exists(x["classes"], lambda c: F.contains(c, F.lit("selected")))), F.get(swatches, F.lit(0)))
    box = _first("__divs", _is(id="feature-bullets"))
    listed = F.transform(_inside(box, _is("span", "a-list-item")), _text)
    plain = _first("__uls", lambda x: F.array_contains(x["classes"], "a-unordered-list") & F.array_contains(x["classes"], "a-vertical"))
    bullets = F.coalesce(F.when(F.exists(listed, lambda t: F.char_length(t) > 10), listed), F.transform(_inside(plain, _is("li")), _text), F.array().cast("array<string>"))
    counts = [F.coalesce(F.size(_inside(_first(_ELEMENTS, _is(id=i)), _is("li"))), F.lit(0)) for i in ("variation_color_name", "variation_size_name")]
    counts = [F.when(c > 0, c) for c in (F.size(swatches), *counts)]
    seller, panel, items = F.col("__seller"), F.col("__panel"), F.col("__items")
    ranks = F.coalesce(_filled(panel), _filled(F.transform(_inside(seller, _is("li")), _spaced)), items)
    told = F.concat(panel, F.array(F.coalesce(_text(seller), F.lit(""))), F.filter(items, lambda t: t.rlike("(?iu)best ?sellers rank|热销商品排名")))
    dated = F.contains(F.array_join(_TEXTS, ""), F.lit("上架时间"))
    since = F.when(dated, _first(spans, lambda x: F.contains(F.array_join(_pieces(x), ""), F.lit("上架时间"))))
    wrapper = _first("__divs", _is(id="imgTagWrapperId"))
    empty = lambda c: F.nullif(c, F.lit(""))
    return {
        "main_image": empty(_first("__imgs", _is(id="landingImage"))["src"]),
        "brand": F.coalesce(_said(_first("__as", _is(id="bylineInfo"))), _said(_cell("brand"))),
        "title": _said(span(id="productTitle"), _first("__h1s", _is(cls="product-title"))),
        "price": F.coalesce(empty(paid), _said(_first(core, _is(cls="a-offscreen"))), F.concat(whole, F.coalesce(fraction, F.lit(""))), _said(deal, span(id="priceblock_ourprice"), span(color="price"))),
        "promo_price": F.coalesce(
            _said(F.get(_inside(shown, _is("span", "a-offscreen")), F.lit(0))),
            _said(deal, span(id="savingPriceOverride"), _first(spans, lambda x: F.array_join(x["classes"], " ").rlike("(?i)deal|discount|sale"))),
        ),
        "rating_text": _said(span(cls="a-icon-alt"), span(hook="rating-out-of-text")),
        "count_text": _said(span(id="acrCustomerReviewText"), span(hook="total-review-count")),
        "bsr_text": _first(told, lambda t: F.contains(t, F.lit("#"))),
        "ranks": ranks,
        "launch_text": F.coalesce(_said(_cell("Date First Available")), _spaced(F.get(F.col(_ELEMENTS), since["parent"]))),
        "variants": F.greatest(*counts),
        "styles_text": empty(F.regexp_extract("html", r"(?iu)\d+\s+styles?\s+available", 0)),
        "color_title": empty(selected["title"]),
        "bullets": bullets,
        "detail_images": _detail_images(),
        "page_title": _said(_first(_ELEMENTS, _is("title"))),
        "heading": _said(F.get(F.col("__h1s"), F.lit(0))),
        "page_lang": empty(_first(_ELEMENTS, _is("html"))["lang"]),
        "links": F.filter(F.transform("__as", lambda x: x["href"]), lambda h: h != ""),
        "wrapped_image": empty(F.get(_inside(wrapper, _is("img")), F.lit(0))["src"]),
        "problem": F.col("__flat.problem"),
    }


def _number(text: Column, pattern: str, kind: str) -> Column:
    return F.replace(F.regexp_extract(text, pattern, 1), F.lit(","), F.lit("")).try_cast(kind)


def parse_pages(pages: DataFrame) -> DataFrame:
    """pages (asin, html, ...) with a struct `page` of _fields(): html rows are large, each is read once, by flatten().

    Which element a field is taken from is told by expressions; a field that nobody asks for isn't computed.
    """
    ship(pages.sparkSession)
    own = pages.columns
    return _with_elements(pages).select(*own, F.struct(*[c.alias(f) for f, c in _fields().items()]).alias("page"))


def product_rows(pages: DataFrame) -> DataFrame:
    """A product row for each page (asin, url, html): fields, status and error.

    A missing page, one that asks for verification and one that can't be parsed give a failed row with its reason.
    Ranks are kept as the texts of the page; a rating, a count or a date that isn't there is null.
    """
    p = parse_pages(pages)
    rank = r"(?U)#\s*([\d,]+)\s+(?:in|在)\s+([^(<]+)"
    ranks = F.filter("page.ranks", lambda t: t.rlike(rank))
    nth = lambda i, g: F.nullif(F.trim(F.regexp_extract(F.get(ranks, F.lit(i)), rank, g)), F.lit(""))
    brand = F.regexp_replace(F.regexp_replace("page.brand", "(?i)^(Visit the |Brand: |品牌：)", ""), "(?i) Store$", "")
    reason = F.when(F.col("html").isNull() | (F.col("html") == ""), "no page").when(needs_verification(F.col("html")), "verification page").when(F.col("page.problem").isNotNull(), "parse error")
    color = F.regexp_extract("page.color_title", r"(?i)select\s+(.+)$", 1)
    date = F.regexp_extract("page.launch_text", r"(\d{4}-\d{1,2}-\d{1,2})", 1)
    return p.select(
        "asin", F.col("url").alias("link"),
        F.coalesce("page.main_image", F.get(urls.dynamic_image_urls(F.col("html")), F.lit(0)), "page.wrapped_image").alias("main_image"),
        F.trim(brand).alias("brand"), F.col("page.title").alias("title"), F.col("page.price").alias("price"), F.col("page.promo_price").alias("promo_price"),
        F.coalesce(_number(F.col("page.rating_text"), r"(?i)([\d.]+)\s*out of", "double"), _number(F.col("page.rating_text"), r"([\d.]+)", "double")).alias("rating"),
        _number(F.col("page.count_text"), r"([\d,]+)", "int").alias("review_count"),
        F.nullif(F.regexp_extract("page.bsr_text", r"#\s*([\d,]+)", 1), F.lit("")).alias("bsr_rank"),
        nth(0, 2).alias("main_category"), nth(0, 1).alias("main_category_rank"), nth(1, 2).alias("sub_category"), nth(1, 1).alias("sub_category_rank"),
        F.when(date != "", date).otherwise(F.col("page.launch_text")).alias("launch_date"),
        F.coalesce("page.variants", _number(F.col("page.styles_text"), r"(\d+)", "int")).alias("variant_count"),
        F.trim(F.when(color != "", color).otherwise(F.col("page.color_title"))).alias("best_selling_color"),
        F.coalesce(F.filter("page.bullets", lambda b: F.char_length(b) > 10), F.array().cast("array<string>")).alias("bullet_points"),
        F.when(reason.isNull(), "success").otherwise("failed").alias("status"), reason.alias("error"),
    )


def page_candidates(pages: DataFrame, strict: bool = True) -> DataFrame:
    """Image candidates of each page (asin, html): asin, candidates."""
    p = parse_pages(pages)
    html = F.coalesce("html", F.lit(""))
    return p.select("asin", candidate_urls(urls.hires_urls(html), F.col("page.detail_images"), urls.page_image_urls(html), strict).alias("candidates"))
