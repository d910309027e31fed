"""Product fields of pages: each stored page is followed by a product's, of which the SQL knows every field.

Every tenth page ends with a question for verification instead, and there is a row without a page beside every tenth.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import pages
from .bindings import spread_table

DETAIL = "https://d.example/aplus-media-library-service-media/"
_RANKS = """concat('<table><tr><th>Best Sellers Rank</th><td><ul><li>#1,', lpad(page_id % 1000, 3, '0'), ' in Home (See Top 100)</li><li>#', page_id % 9 + 1, ' in Lamps</li></ul></td></tr></table>')"""
_PANEL = """concat('<p class="bsr-list-item"><span class="rank-box">#', page_id + 1, '</span> <span class="exts-color-blue">Garden</span></p>')"""
_PRICE = """case page_id % 8
  when 3 then concat('<span id="priceblock_dealprice">$', page_id, '.10</span><span id="priceblock_ourprice">$', page_id, '.20</span>')
  when 7 then concat('<span id="priceblock_ourprice">$', page_id, '.20</span><span class="x-discount">$', page_id, '.15</span>')
  else concat('<div id="corePriceDisplay_desktop_feature_div">', case page_id % 4
    when 0 then concat('<span id="apex-pretend-apex-pricetopay-accessibility-label">$', page_id, '.50</span>')
    when 1 then concat('<span class="a-price a-text-price"><span>$', page_id, '.00</span></span><span class="a-price"><span class="a-offscreen">$', page_id, '.99</span></span>')
    else concat('<span class="a-price-whole">', page_id, '.</span><span class="a-price-fraction">25</span>') end, '</div>') end"""
_IMAGE = """concat(case page_id % 3 when 0 then concat('<img id="landingImage" src="https://m.media-amazon.com/images/I/', page_id, '._AC_SX679_.jpg">')
  when 1 then concat('<img data-a-dynamic-image=''{"https://i.example/', page_id, '.jpg":[10,20]}''><img data-a-dynamic-image="broken">')
  else concat('<div id="imgTagWrapperId"><img src="https://w.example/', page_id, '.jpg"></div>') end)""".replace("''", "\\'")
_LAUNCH = """case page_id % 3 when 0 then '<table><tr><th>Date First Available</th><td>January 5, 2024</td></tr></table>' when 1 then '<table><tr><th> Date First Available </th><td>on 2024-1-05</td></tr></table>'
  else '<div><span>上架时间：</span> <span>2023-02-11</span></div>' end"""
_VARIANTS = """case page_id % 3 when 0 then concat('<li class="swatchElement selected" title="Click to select C', page_id, '"></li>', repeat('<li class="swatchElement"></li>', cast(page_id % 5 as int)))
  when 1 then concat('<ul id="variation_color_name">', repeat('<li></li>', cast(page_id % 4 + 1 as int)), '</ul>') else concat('<p>', page_id % 6 + 2, ' styles available</p>') end"""
_BULLETS = """case page_id % 2 when 0 then concat('<div id="feature-bullets"><span class="a-list-item">short</span><span class="a-list-item"> long enough ', page_id, '</span><span class="a-list-item">another long one</span></div>')
  else concat('<ul class="x a-vertical a-unordered-list"><li>short</li><li>listed and long ', page_id, '</li></ul>') end"""
_DETAIL = f"""concat('<script type="text/javascript">x = {{"hiRes":"https://h.example/', page_id, '.jpg"}}</script><div id="aplus"><img src="{DETAIL[6:]}', page_id, '.jpg"><div class="comparison-table"><img src="{DETAIL}no.jpg"></div>',
  '<a href="/dp/BOTHER0002"><img src="{DETAIL}other.jpg"></a><a href="/dp/', asin, '"><img data-src="{DETAIL}own.jpg"></a></div><img src="{DETAIL}outside.jpg">')"""
#: The page of a product, in Spark's SQL.
PRODUCT = f"""concat('<div>', case page_id % 2 when 0 then concat('<a id="bylineInfo">Visit the B', page_id % 7, ' Store</a><span id="productTitle"> Lamp ', page_id, ' </span>')
  else concat('<table><tr><th>Brand</th><td>B', page_id % 7, '</td></tr></table><h1 class="product-title">Tree ', page_id, '</h1>') end, {_PRICE}, {_IMAGE},
  case page_id % 3 when 0 then concat('<span class="a-icon-alt">', page_id % 5, '.', page_id % 10, ' out of 5 stars</span>') when 1 then concat('<span data-hook="rating-out-of-text">', page_id % 5, ' of 5</span>') else '' end,
  case page_id % 2 when 0 then concat('<span id="acrCustomerReviewText">1,', lpad(page_id % 1000, 3, '0'), ' ratings</span>') else concat('<span data-hook="total-review-count">', page_id, ' ratings</span>') end,
  case page_id % 2 when 0 then {_RANKS} else {_PANEL} end, {_LAUNCH}, {_VARIANTS}, {_BULLETS}, {_DETAIL}, '</div>')"""
ASIN = "concat('B', lpad(page_id, 9, '0'))"
HTML = f"case page_id % 10 when 9 then concat(coalesce(html, ''), '<p>Enter the Characters you see below</p>') else concat(coalesce(html, ''), {PRODUCT}) end"

_ASIN_SQL = "'B' || lpad(page_id::varchar, 9, '0')"
_THOUSAND = "'1,' || lpad((page_id % 1000)::varchar, 3, '0')"
#: What is added to the id of a page for the row without one beside it.
MISSING = 1_000_000
_ROWS_SQL = f"select page_id, url, page_id % 10 <> 9 as whole, false as missing from pages union all select page_id + {MISSING}, url, false, true from pages where page_id % 10 = 8"
PRODUCTS_SQL = f"""with p as ({_ROWS_SQL})
select {_ASIN_SQL} as asin, url as link,
  case when whole then case page_id % 3 when 0 then 'https://m.media-amazon.com/images/I/' || page_id || '._AC_SX679_.jpg' when 1 then 'https://i.example/' || page_id || '.jpg' else 'https://w.example/' || page_id || '.jpg' end end as main_image,
  case when whole then 'B' || page_id % 7 end as brand, case when whole then case page_id % 2 when 0 then 'Lamp ' else 'Tree ' end || page_id end as title,
  case when whole then case when page_id % 8 = 3 then '$' || page_id || '.10' when page_id % 8 = 7 then '$' || page_id || '.20' when page_id % 4 = 0 then '$' || page_id || '.50' when page_id % 4 = 1 then '$' || page_id || '.99' else page_id || '.25' end end as price,
  case when whole then case when page_id % 8 = 3 then '$' || page_id || '.10' when page_id % 8 = 7 then '$' || page_id || '.15' when page_id % 4 = 1 then '$' || page_id || '.99' end end as promo_price,
  case when whole then case page_id % 3 when 0 then (page_id % 5) + (page_id % 10) / 10.0 when 1 then page_id % 5 end end::double as rating,
  case when whole then case page_id % 2 when 0 then 1000 + page_id % 1000 else page_id end end::int as review_count,
  case when whole then case page_id % 2 when 0 then {_THOUSAND} else (page_id + 1)::varchar end end as bsr_rank,
  case when whole then case page_id % 2 when 0 then 'Home' else 'Garden' end end as main_category,
  case when whole then case page_id % 2 when 0 then {_THOUSAND} else (page_id + 1)::varchar end end as main_category_rank,
  case when whole and page_id % 2 = 0 then 'Lamps' end as sub_category, case when whole and page_id % 2 = 0 then (page_id % 9 + 1)::varchar end as sub_category_rank,
  case when whole then case page_id % 3 when 0 then 'January 5, 2024' when 1 then '2024-1-05' else '2023-02-11' end end as launch_date,
  case when whole then case page_id % 3 when 0 then page_id % 5 + 1 when 1 then page_id % 4 + 1 else page_id % 6 + 2 end end::int as variant_count,
  case when whole and page_id % 3 = 0 then 'C' || page_id end as best_selling_color,
  case when whole then case page_id % 2 when 0 then 'long enough ' || page_id || '; another long one' else 'listed and long ' || page_id end else '' end as bullet_points,
  case when whole then 'success' else 'failed' end as status, case when missing then 'no page' when not whole then 'verification page' end as error
from p"""
CANDIDATES_SQL = f"""select {_ASIN_SQL} as asin, case when not whole then '' else 'https://h.example/' || page_id || '.jpg {DETAIL}' || page_id || '.jpg {DETAIL}own.jpg' ||
  case page_id % 3 when 0 then ' https://m.media-amazon.com/images/I/' || page_id || '._AC_SX679_.jpg' when 1 then ' https://i.example/' || page_id || '.jpg' else '' end end as candidates from ({_ROWS_SQL})"""


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = spread_table(spark, sf_dir, "pages").withColumn("html", F.coalesce("html", F.lit("")))
    missing = stored.filter("page_id % 10 = 8").withColumn("page_id", F.col("page_id") + MISSING).withColumn("html", F.lit(None).cast("string"))
    pages_ = stored.withColumn("asin", F.expr(ASIN)).withColumn("html", F.expr(HTML))
    return pages_.unionByName(missing.withColumn("asin", F.expr(ASIN)))


def p1_p7_product_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every field of every page's product, pages that are missing or ask for verification among them."""
    return pages.product_rows(_pages(spark, sf_dir)).withColumn("bullet_points", F.array_join("bullet_points", "; "))


def p8_page_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.page_candidates(_pages(spark, sf_dir), strict=False).withColumn("candidates", F.array_join("candidates", " "))
