"""Column functions on product and image urls."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Shops by country, and the one for any other.
DOMAINS = {"us": "https://www.amazon.com", "uk": "https://www.amazon.co.uk", "de": "https://www.amazon.de", "jp": "https://www.amazon.co.jp", "ca": "https://www.amazon.ca"}
DEFAULT_DOMAIN = "us"
#: Fixed value: the size that image urls are raised to.
LARGE = "_SL1500_"
#: Hosts of product images, size marks in their urls, and the token of images in detail sections.
IMAGE_HOSTS = ["images-na.ssl-images-amazon.com", "m.media-amazon.com", "images-amazon.com"]
SIZE_MARKS = ["_AC_", "_SL", "_SX", "_SY"]
DETAIL_TOKEN = "aplus-media-library-service-media"


def product_url(asin: Column, domain: Column) -> Column:
    shops = F.create_map(*[F.lit(x) for pair in DOMAINS.items() for x in pair])
    return F.concat(F.coalesce(F.try_element_at(shops, F.lower(domain)), F.lit(DOMAINS[DEFAULT_DOMAIN])), F.lit("/dp/"), asin)


def upgrade(url: Column) -> Column:
    """The url of the large image: the size is dropped, LARGE put before the extension.

    A url without a size gets LARGE without a dot in front, and one that is large already gets it twice.
    """
    # Fixed value: how a size is written in a url.
    plain = F.regexp_replace(url, r"\._[A-Z]{2,3}_[A-Z]{2}\d+_", ".")
    return F.regexp_replace(plain, r"\.([a-z]+)$", f"{LARGE}.$1")


def url_key(url: Column) -> Column:
    """What two sizes of one image have in common."""
    return F.regexp_replace(url, r"\._[A-Z_0-9]+\.", ".")


def file_name(asin: Column, index: Column, url: Column) -> Column:
    """asin_index.extension, jpg where the url has none of the usual ones."""
    kind = F.lower(F.regexp_extract(url, r"(?i)\.(jpg|jpeg|png|webp)(?:\?|$)", 1))
    return F.concat(asin, F.lit("_"), F.lpad(index.cast("string"), 2, "0"), F.lit("."), F.when(kind == "", "jpg").otherwise(kind))


def hires_urls(html: Column) -> Column:
    """Urls of "hiRes" entries, unescaped, https only, each once, in order."""
    # Fixed value: how an entry is written in a page.
    raw = F.regexp_extract_all(html, F.lit(r'"hiRes"\s*:\s*"([^"]+)"'), 1)
    plain = F.transform(raw, lambda u: F.replace(F.replace(F.replace(u, F.lit("\\/"), F.lit("/")), F.lit("\\u0026"), F.lit("&")), F.lit("\\u002F"), F.lit("/")))
    return F.array_distinct(F.filter(plain, lambda u: u.startswith("https://")))


def dynamic_image_urls(html: Column) -> Column:
    """Keys of the JSON maps in data-a-dynamic-image attributes; an attribute that is no JSON map is skipped."""
    raw = F.regexp_extract_all(html, F.lit(r"""data-a-dynamic-image=(?:"([^"]*)"|'([^']*)')"""), 0)
    text = F.transform(raw, lambda a: F.replace(F.regexp_replace(a, r"""^data-a-dynamic-image=.|.$""", ""), F.lit("&quot;"), F.lit('"')))
    keys = F.transform(text, lambda a: F.coalesce(F.map_keys(F.from_json(a, "map<string,array<int>>")), F.array().cast("array<string>")))
    return F.array_distinct(F.flatten(keys))


def page_image_urls(html: Column) -> Column:
    """Urls of images anywhere in a page: dynamic images, the landing image, sized images of known hosts, urls in scripts."""
    landing = F.regexp_extract_all(html, F.lit(r"""<img\b(?=[^>]*\bid=["']landingImage["'])[^>]*\bsrc=["']([^"']+)["']"""), 1)
    images = F.regexp_extract_all(html, F.lit(r"""<img\b[^>]*\bsrc=["']([^"']+)["']"""), 1)
    known = lambda u: F.exists(F.array(*map(F.lit, IMAGE_HOSTS)), lambda h: F.contains(u, h)) & F.exists(F.array(*map(F.lit, SIZE_MARKS)), lambda m: F.contains(u, m))
    scripts = F.regexp_extract_all(html, F.lit(r"""(?s)<script type="text/javascript">(.*?)</script>"""), 1)
    # Fixed value: an image's url in a script.
    script = r"""https://[^"']+(?:images-na\.ssl-images-amazon|m\.media-amazon)\.com/images/I/[^"']+\.(?:jpg|jpeg|png)"""
    found = F.flatten(F.transform(scripts, lambda s: F.regexp_extract_all(s, F.lit(script), 0)))
    web = lambda u: u.startswith("http")
    return F.array_distinct(F.concat(dynamic_image_urls(html), F.slice(F.filter(landing, web), 1, 1), F.filter(images, lambda u: known(u) & web(u)), found))
