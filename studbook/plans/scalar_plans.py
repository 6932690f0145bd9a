"""Column functions applied to whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as d, display as show, numbers as num, text as tx
from . import query

UUID_RE = tx.UUID_PATTERN


@query("parse_date_multi", """
select id, cast(coalesce(try_strptime(trim(date_text), '%d %b %Y'), try_strptime(trim(date_text), '%d/%m/%Y'), try_strptime(trim(date_text), '%Y-%m-%d'),
  try_strptime(trim(date_text), '%b %d, %Y'), try_strptime(trim(date_text), '%B %d, %Y')) as date) as parsed from raw_values""")
def parse_date_multi(t):
    return t("raw_values").select("id", d.parse_date_multi(F.col("date_text")).cast("date").alias("parsed"))


US_TEXT = """
select id, case when id % 3 = 0 then concat(cast(1 + id % 12 as string), '/', cast(1 + id % 28 as string), '/2024, 08:', cast(10 + id % 50 as string))
  when id % 3 = 1 then concat('2024-', lpad(cast(1 + id % 12 as string), 2, '0'), '-05') else 'soon' end as raw from raw_values"""


@query("parse_datetime_us", f"select id, coalesce(try_strptime(raw, '%Y-%m-%d'), try_strptime(raw, '%m/%d/%Y, %H:%M')) as parsed from ({US_TEXT}) u")
def parse_datetime_us(t):
    return t.sql(US_TEXT).select("id", d.parse_datetime_us(F.col("raw")).alias("parsed"))


@query("parse_datetime_listing", "select pos, try_strptime(modified_text, '%d/%m/%Y, %H:%M') as parsed from listing_feed")
def parse_datetime_listing(t):
    return t("listing_feed").select("pos", d.parse_datetime_listing(F.col("modified_text")).alias("parsed"))


RU_MONTH = " ".join(f"when '{m}' then {i}" for i, m in enumerate(d.RUSSIAN_MONTHS, 1))
RU_TEXT = 'regexp_extract(html, \'Дата рождения:</div><div class="textDescription">([^<]*)<\', 1)'


@query("parse_date_ru", f"""
select page_id, make_date(cast(split_part(raw, ' ', 3) as bigint), case split_part(raw, ' ', 2) {RU_MONTH} end, cast(split_part(raw, ' ', 1) as bigint)) as parsed
from (select page_id, {RU_TEXT} as raw from html_labels) h""")
def parse_date_ru(t):
    raw = F.regexp_extract("html", 'Дата рождения:</div><div class="textDescription">([^<]*)<', 1)
    return t("html_labels").select("page_id", d.parse_date_ru(raw).cast("date").alias("parsed"))


DOTTED = "select id, case when id % 7 = 0 then 'n/a' else concat(lpad(cast(1 + id % 28 as string), 2, '0'), '.', cast(1 + id % 12 as string), '.2021', case when id % 2 = 0 then '.' else '' end) end as raw from raw_values"


@query("parse_date_dotted", f"select id, cast(try_strptime(rtrim(raw, '.'), '%d.%m.%Y') as date) as parsed from ({DOTTED}) x")
def parse_date_dotted(t):
    return t.sql(DOTTED).select("id", d.parse_date_dotted(F.col("raw")).cast("date").alias("parsed"))


CELLS = r"regexp_extract_all(html, '<td>(.*?)</td>', 1)"


@query("parse_date_cert", f"select page_id, html, cast(try_strptime(({CELLS})[2], '%b %d %Y') as date) as parsed from html_medical")
def parse_date_cert(t):
    cells = F.regexp_extract_all("html", F.lit("<td>(.*?)</td>"), F.lit(1))
    return t("html_medical").select("page_id", "html", d.parse_date_cert(F.element_at(cells, 2)).cast("date").alias("parsed"))


@query("parse_age", f"select page_id, html, try_cast(({CELLS})[4] as int) as age from html_medical")
def parse_age(t):
    cells = F.regexp_extract_all("html", F.lit("<td>(.*?)</td>"), F.lit(1))
    return t("html_medical").select("page_id", "html", num.parse_int(F.element_at(cells, 4)).alias("age"))


INT_TEXT = "select id, case when id % 4 = 0 then concat(' ', cast(id as string), ' ') when id % 4 = 1 then concat(cast(id as string), '.5') when id % 4 = 2 then '' else concat('-', cast(id % 99 as string)) end as raw from raw_values"


@query("parse_int", f"select id, case when id % 4 in (0, 3) then try_cast(trim(raw) as int) end as parsed from ({INT_TEXT}) x")
def parse_int(t):
    return t.sql(INT_TEXT).select("id", num.parse_int(F.col("raw")).alias("parsed"))


@query("parse_float", "select id, try_cast(num_text as double) as parsed from raw_values")
def parse_float(t):
    return t("raw_values").select("id", num.parse_float(F.col("num_text")).alias("parsed"))


COI_TEXT = "select id, case when id % 3 = 0 then concat('0.', cast(id % 90 as string)) when id % 3 = 1 then 'unknown' else '1.5d' end as raw from raw_values"


@query("parse_coi", f"select id, case when id % 3 = 0 then cast(raw as double) end as parsed from ({COI_TEXT}) x")
def parse_coi(t):
    return t.sql(COI_TEXT).select("id", num.parse_float(F.col("raw")).alias("parsed"))


HREF = "regexp_extract(html, 'href=\"([^\"]*)\"', 1)"


@query("extract_uuid", f"select page_id, nullif(regexp_extract(html, '({UUID_RE})', 1), '') as uuid from card_pages")
def extract_uuid(t):
    return t("card_pages").select("page_id", tx.extract_uuid(F.col("html")).alias("uuid"))


@query("split_slug_uuid", f"""
select page_id, nullif(regexp_extract(href, '-([a-f0-9-]{{36}})$', 1), '') as uuid,
  case when regexp_matches(href, '-[a-f0-9-]{{36}}$') then concat('dog-', cast(page_id as string)) end as slug from (select page_id, {HREF} as href from card_pages) c""")
def split_slug_uuid(t):
    href = F.regexp_extract("html", 'href="([^"]*)"', 1)
    return t("card_pages").select("page_id", tx.path_uuid(href).alias("uuid"), tx.path_slug(href).alias("slug"))


@query("slug_from_query", f"select page_id, case when contains(href, 'name=') then string_split(href, 'name=')[-1] end as slug from (select page_id, {HREF} as href from html_labels) h")
def slug_from_query(t):
    return t("html_labels").select("page_id", tx.slug_from_query(F.regexp_extract("html", 'href="([^"]*)"', 1)).alias("slug"))


@query("next_page_url", """
select id, case when id % 3 = 0 then replace(url, concat('start=', cast(id as string), '&'), concat('start=', cast(id + 50 as string), '&'))
  when id % 3 = 1 then 'http://x/results.php?mode=advanced&photos=photos&start=50' else concat('http://x/results.php?start=', cast(id % 500 + 50 as string)) end as next_url from listing_url""")
def next_page_url(t):
    return t("listing_url").select("id", tx.next_page_url(F.col("url"), 50).alias("next_url"))


@query("surrogate_uuid", "select id, md5(registered_name) as by_name, md5(concat('feed_', registered_name)) as by_feed from registry")
def surrogate_uuid(t):
    name = F.col("registered_name")
    return t("registry").select("id", tx.surrogate_uuid(name).alias("by_name"), tx.surrogate_uuid(name, "feed_").alias("by_feed"))


CAMEL = "select id, concat('Name', replace(registered_name, ' ', 'Of'), 'XyZ') as raw from registry"


@query("to_snake_case", f"select id, lower(concat(substr(raw, 1, 1), regexp_replace(substr(raw, 2), '([A-Z])', '_\\1', 'g'))) as snake from ({CAMEL}) c")
def to_snake_case(t):
    return t.sql(CAMEL).select("id", tx.to_snake_case(F.col("raw")).alias("snake"))


@query("clean_text", "select id, trim(regexp_replace(reg_text, '\\s+', ' ', 'g')) as cleaned from raw_values")
def clean_text(t):
    return t("raw_values").select("id", tx.clean_text(F.col("reg_text")).alias("cleaned"))


@query("strip_reg_number", "select id, replace(reg_text, ' ', '') as number from raw_values")
def strip_reg_number(t):
    return t("raw_values").select("id", tx.strip_reg_number(F.col("reg_text")).alias("number"))


NAMED = "select id, case when id % 3 = 0 then registered_name else concat(registered_name, ' (', coalesce(call_name, 'none'), ') (x)') end as raw from registry"


@query("extract_call_name", f"select id, nullif(regexp_extract(raw, '\\(([^)]+)\\)', 1), '') as call_name from ({NAMED}) n")
def extract_call_name(t):
    return t.sql(NAMED).select("id", tx.extract_call_name(F.col("raw")).alias("call_name"))


@query("extract_year", "select id, try_cast(nullif(regexp_extract(date_text, '(\\d{4})', 1), '') as int) as year from raw_values")
def extract_year(t):
    return t("raw_values").select("id", tx.extract_year(F.col("date_text")).alias("year"))


SEX = "select id, case when id % 4 = 0 then 'Male' when id % 4 = 1 then ' FEMALE ' when id % 4 = 2 then '' else 'male' end as raw from registry"


@query("sex_code", f"select id, case when lower(trim(raw)) = 'male' then 1 else 2 end as sex from ({SEX}) s")
def sex_code(t):
    return t.sql(SEX).select("id", num.sex_code(F.col("raw")).alias("sex"))


@query("sex_label", "select id, case when sex = 1 then 'male' else 'female' end as label from registry")
def sex_label(t):
    return t("registry").select("id", num.sex_label(F.col("sex")).alias("label"))


@query("photo_url_from_path", "select id, case when photo_url is not null then concat('http://x/resource/', photo_url) end as url from registry")
def photo_url_from_path(t):
    return t("registry").select("id", tx.photo_url_from_path(F.col("photo_url"), "http://x/resource/").alias("url"))


PHOTOS = "select id, case when id % 4 = 0 then null when id % 4 = 1 then concat('a', cast(id as string), '_s.jpg; ;b_s.jpg') when id % 4 = 2 then '; x_s.jpg ' else 'one_s.jpg' end as raw from registry"


@query("photo_urls", f"""
select id, case when id % 4 = 0 then '' when id % 4 = 1 then concat('a', cast(id as string), '_s.jpg|b_s.jpg') when id % 4 = 2 then 'x_s.jpg' else 'one_s.jpg' end as urls,
  case when id % 4 = 1 then concat('a', cast(id as string), '_s.jpg') when id % 4 = 3 then 'one_s.jpg' end as thumbnail from ({PHOTOS}) p""")
def photo_urls(t):
    raw = F.col("raw")
    return t.sql(PHOTOS).select("id", F.array_join(tx.photo_urls(raw), "|").alias("urls"), tx.photo_thumbnail(raw).alias("thumbnail"))


@query("photo_medium_size", "select id, regexp_replace(coalesce(photo_url, ''), '_s\\.jpg$', '_m.jpg') as medium from registry")
def photo_medium_size(t):
    return t("registry").select("id", tx.photo_medium_size(F.col("photo_url")).alias("medium"))


RU_NAME = " ".join(f"when {i} then '{m}'" for i, m in enumerate(d.RUSSIAN_MONTHS, 1))


@query("format_date_long", f"""
select id, case when date_of_death is null then 'Unknown' else concat(cast(day(date_of_death) as string), ' ', case month(date_of_death) {RU_NAME} end,
  ' ', cast(year(date_of_death) as string), ' г.') end as shown from registry_ext""")
def format_date_long(t):
    return t("registry_ext").select("id", d.format_date_long(F.col("date_of_death")).alias("shown"))


@query("color_text", """
select id, case when coalesce(color, '') = '' then '—' when coalesce(color_marking, '') = '' then color else concat(color, ' (', color_marking, ')') end as shown from registry_ext""")
def color_text(t):
    return t("registry_ext").select("id", show.color_text(F.col("color"), F.col("color_marking")).alias("shown"))


@query("safe_file_name", "select id, regexp_replace(registered_name, '[^a-zA-Z0-9]', '_', 'g') as file_name from registry")
def safe_file_name(t):
    return t("registry").select("id", tx.safe_file_name(F.col("registered_name")).alias("file_name"))
