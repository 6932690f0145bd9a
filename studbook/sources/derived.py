"""Registry-shaped tables derived from the driver tables, in SQL that Spark and DuckDB both accept.

Every view is one query over the given tables, so its size follows theirs.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..session import settle

BASE_TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

VIEWS: dict[str, str] = {}

VIEWS["registry"] = """
select id, md5(concat('dog_', cast(id as string))) as uuid,
  concat('Arctic ', substr(md5(concat('n', cast(id as string))), 1, 12)) as registered_name,
  case when id % 4 = 0 then null else concat('call', cast(id % 50 as string)) end as call_name,
  case when id % 2 = 1 then 1 else 2 end as sex,
  case when f is null then null when litter_no % 13 = 0 then null else 2*((f2 - 1) - ((litter_no*7) % 8)) + 1 end as sire_id,
  case when f is null then null when litter_no % 17 = 0 then null else 2*((f2 - 1) - ((litter_no*5) % 9)) + 2 end as dam_id,
  case when f is null then date '1990-01-01' else date '1990-02-01' + cast(litter_no*12 as int) end as date_of_birth,
  concat('NATION_', cast(c_nationkey as string)) as land_of_birth,
  case when id % 6 = 0 then null else c_mktsegment end as color,
  case when id % 5 = 0 then null else 15.5 + cast(id % 20 as double) end as weight,
  id % 3 = 0 as neutered,
  case when id % 7 = 0 then null else concat('p/', cast(id as string), '_s.jpg') end as photo_url,
  'source_a' as source
from (select c.*, cast(floor(f/2) as bigint) as f2 from (
  select b.*, case when id <= 20 then null else 21 + 4*litter_no end as f from (
    select c_custkey + 1 as id, c_nationkey, c_acctbal, c_mktsegment,
           case when c_custkey + 1 <= 20 then null else cast(floor((c_custkey + 1 - 21)/4) as bigint) end as litter_no
    from customer) b) c) d
"""

VIEWS["registry_named"] = """
select r.*, s.registered_name as sire_name, d.registered_name as dam_name
from registry r left join registry s on r.sire_id = s.id left join registry d on r.dam_id = d.id
"""

VIEWS["owner"] = """
select s_suppkey as id, s_name as name, md5(s_name) as uuid, s_suppkey % 2 = 0 as is_main_owner from supplier
"""

VIEWS["dog_owner"] = """
select distinct o_custkey + 1 as dog_id, l_suppkey as owner_id from lineitem join orders on l_orderkey = o_orderkey where l_linenumber % 2 = 1
"""

VIEWS["medical_record"] = """
select event_id as id, user_id + 1 as dog_id, event_type as registry, ts as test_date, cast(floor(value) as int) as age_in_months,
  concat('OFA-', cast(user_id as string), '-', cast(event_id % 97 as string)) as ofa_number from events
"""

VIEWS["incoming"] = """
select id as rec_id,
  case when k = 0 then registered_name when k = 3 then concat(substr(registered_name, 1, 18), '~')
       else concat('Boreal ', substr(md5(concat('x', cast(id as string))), 1, 12)) end as registered_name,
  case when k = 1 then uuid else md5(concat('in_', cast(id as string))) end as uuid,
  case when k = 2 or id % 2 = 0 then date_of_birth else null end as date_of_birth,
  case when k = 4 then null else sire_name end as sire_name,
  case when k = 4 then null else dam_name end as dam_name,
  case when id % 4 = 0 then '' when id % 4 = 1 then 'AMENDED' else color end as color,
  land_of_birth,
  case when id % 9 = 0 then weight + 1 else weight end as weight,
  'source_b' as source
from (select r.*, id % 5 as k from registry_named r) t
"""

# Pages of a batch: one for every animal, a third of them under a name the registry doesn't hold, and second pages of some
# new animals, under the same name or one with a letter more.
VIEWS["ingest_facts"] = """
select f.*, concat('s', cast(f.page_id as string)) as slug from (
  select id as page_id, id, 0 as copy, id % 3 = 0 as is_new, sire_id, dam_id, sex,
    case when id % 3 = 0 then concat('Boreal ', substr(md5(concat('x', cast(id as string))), 1, 12)) else registered_name end as name,
    case when id % 3 = 0 then date_of_birth + cast(11 + id % 20000 as int) else date_of_birth end as born,
    case when id % 4 = 0 then '' when id % 4 = 1 then 'AMENDED' else coalesce(color, '') end as color,
    case when id % 10 = 9 then '' else concat('Owner ', cast(id % 50 as string)) end as owner,
    case when id % 2 = 0 then concat('Breeder ', cast(id % 40 as string)) else '' end as breeder from registry
  union all
  select id + case when id % 15 = 0 then 10000000 else 20000000 end, id, case when id % 15 = 0 then 1 else 2 end, true, cast(null as bigint), cast(null as bigint), sex,
    concat('Boreal ', substr(md5(concat('x', cast(id as string))), 1, 12), case when id % 15 = 0 then '' else '~' end), cast(null as date), 'COPY', '', '' from registry where id % 15 in (0, 3)) f
"""

VIEWS["ingest_pages"] = """
select f.page_id, concat('http://b/details.php?name=', f.slug) as url, concat('<div class="titlename"><h1 itemprop="name"> ', f.name, ' </h1></div><div class="generalInfo">',
  '<div class="textRow"><div class="textLabel">Пол:</div><div class="textDescription">', case when f.sex = 1 then 'Male' else 'Female' end, '</div></div>',
  case when f.born is null then '' else concat('<div class="textRow"><div class="textLabel">Дата рождения:</div><div class="textDescription">', cast(day(f.born) as string), ' ',
    case month(f.born) when 1 then 'января' when 2 then 'февраля' when 3 then 'марта' when 4 then 'апреля' when 5 then 'мая' when 6 then 'июня' when 7 then 'июля'
      when 8 then 'августа' when 9 then 'сентября' when 10 then 'октября' when 11 then 'ноября' else 'декабря' end, ' ', cast(year(f.born) as string), '</div></div>') end,
  '<div class="textRow"><div class="textLabel">Окрас:</div><div class="textDescription">', f.color, '</div></div>',
  case when s.slug is null then '' else concat('<div class="textRow"><div class="textLabel">Отец:</div><div class="textDescription"><a href="details.php?name=', s.slug, '">', s.name, '</a></div></div>') end,
  case when d.slug is null then '' else concat('<div class="textRow"><div class="textLabel">Мать:</div><div class="textDescription"><a href="details.php?name=', d.slug, '">', d.name, '</a></div></div>') end,
  case when f.owner = '' then '' else concat('<div class="textRow"><div class="textLabel">Владелец:</div><div class="textDescription"><a href="o.php?x=1">', f.owner, '</a>',
    case when f.id % 4 = 0 then '<a href="o.php?x=2">Second Owner</a>' else '' end, '</div></div>') end,
  case when f.breeder = '' then '' else concat('<div class="textRow"><div class="textLabel">Заводчик:</div><div class="textDescription"><a href="o.php?x=3">', f.breeder, '</a></div></div>') end,
  '</div><div class="siblings">', case when f.copy = 0 and f.id % 4 = 1 then concat('<a href="details.php?name=s', cast(f.id + 1 as string), '">x</a>') else '' end, '</div>',
  '<div class="children">', coalesce(k.links, ''), '</div>') as html
from ingest_facts f left join ingest_facts s on s.page_id = f.sire_id left join ingest_facts d on d.page_id = f.dam_id
left join (select dam_id, string_agg(concat('<a href="details.php?name=', slug, '">', name, '</a>'), '') as links from ingest_facts where dam_id % 7 = 0 group by dam_id) k
  on k.dam_id = f.id and f.copy = 0
"""

VIEWS["raw_values"] = """
select o_orderkey as id,
  case when o_orderkey % 6 = 0 then concat(cast(1 + o_orderkey % 28 as string), ' Dec 2022')
       when o_orderkey % 6 = 1 then concat(cast(1 + o_orderkey % 28 as string), '/12/2022')
       when o_orderkey % 6 = 2 then concat('2022-12-', lpad(cast(1 + o_orderkey % 28 as string), 2, '0'))
       when o_orderkey % 6 = 3 then concat('Dec ', cast(1 + o_orderkey % 28 as string), ', 2022')
       when o_orderkey % 6 = 4 then concat('December ', cast(1 + o_orderkey % 28 as string), ', 2022')
       else 'unknown' end as date_text,
  case when o_orderkey % 3 = 0 then '' when o_orderkey % 3 = 1 then cast(o_totalprice as string) else 'n/a' end as num_text,
  concat('  AB ', cast(o_orderkey as string), '  C ') as reg_text
from orders
"""

VIEWS["title"] = """
select p_partkey as id, p_partkey + 1 as dog_id, p_type as short_name,
  case when p_partkey % 3 = 0 then null else p_name end as long_name,
  p_partkey % 2 = 0 as is_prefix, p_size > 25 as has_winner_year, 2000 + p_size % 20 as winner_year from part
"""

VIEWS["litter"] = """
select min(id) as id, dam_id, sire_id, date_of_birth,
  cast(sum(case when sex = 1 then 1 else 0 end) as bigint) as male_count, cast(sum(case when sex = 2 then 1 else 0 end) as bigint) as female_count
from registry where dam_id is not null and sire_id is not null group by dam_id, sire_id, date_of_birth
"""

VIEWS["link_table"] = """
select concat('u/', cast(id as string)) as url, concat('u/', cast(sire_id as string)) as link, 'sire' as kind from registry where sire_id is not null
union all
select concat('u/', cast(id as string)), concat('u/', cast(dam_id as string)), 'dam' from registry where dam_id is not null
"""

VIEWS["html_script"] = """
select id as page_id, concat('<script>var animal = {"uuid":"', uuid, '","sex":', cast(sex as string), ',"color":"', coalesce(color, ''), '"}; var siblings = [{"uuid":"s', cast(id % 9 as string), '"}];</script>') as html from registry
"""

VIEWS["html_labels"] = """
select id as page_id, concat('<div class="titlename"><h1 itemprop="name"> ', registered_name, ' </h1></div><div class="generalInfo">',
  '<div class="textRow"><div class="textLabel">Окрас:</div><div class="textDescription">', coalesce(color, ''), '</div></div>',
  '<div class="textRow"><div class="textLabel">Отец:</div><div class="textDescription"><a href="details.php?name=', coalesce(cast(sire_id as string), ''), '">', coalesce(sire_name, ''), '</a></div></div>',
  '<div class="textRow"><div class="textLabel">Дата рождения:</div><div class="textDescription">', cast(1 + id % 28 as string), case when id % 2 = 0 then ' мая ' else ' декабря ' end, cast(2000 + id % 20 as string), '</div></div></div>') as html from registry_named
"""

VIEWS["html_medical"] = """
select dog_id as page_id, concat('<tr><td>', registry, '</td><td>Jan ', lpad(cast(1 + id % 28 as string), 2, '0'), ' 2020</td><td></td><td>', case when id % 10 = 0 then '' else cast(age_in_months as string) end, '</td><td>NORMAL</td><td>', ofa_number, '</td></tr>') as html from medical_record
"""

VIEWS["resolution"] = """
select rec_id as dog_id, case when rec_id % 2 = 0 then land_of_birth else null end as land_of_birth, case when rec_id % 4 = 1 then color else null end as color from incoming
"""

# Listing order is newest first. The position is a sort key built from the instant and the event id,
# so no global numbering of the table is needed.
VIEWS["listing_feed"] = """
select -(((((((cast(year(ts) as bigint) - 2000) * 12 + month(ts)) * 31 + day(ts)) * 24 + hour(ts)) * 60 + minute(ts)) * 60
    + cast(floor(second(ts)) as bigint)) * 1000000000) + event_id as pos,
  md5(concat('dog_', cast(user_id + 1 as string))) as uuid, event_type as status, value,
  case when event_id % 50 = 0 then 'n/a' else concat(cast(day(ts) as string), '/', cast(month(ts) as string), '/', cast(year(ts) as string), ', ',
    lpad(cast(hour(ts) as string), 2, '0'), ':', lpad(cast(minute(ts) as string), 2, '0')) end as modified_text
from events
"""

VIEWS["registry_ext"] = """
select n.*,
  case when id % 11 = 0 then null when id % 11 = 1 then cast(0 as double) else cast(id % 13 as double) / 100 end as coi,
  case when id % 8 = 0 then null else concat('RN ', cast(id as string)) end as registration_number,
  concat('NATION_', cast((id * 7) % 25 as string)) as land_of_standing,
  case when id % 4 = 0 then null when id % 4 = 1 then '' else concat('mask', cast(id % 3 as string)) end as color_marking,
  case when id % 10 = 3 then null else id % 4 = 1 end as approved_for_breeding,
  case when id % 10 = 4 then null else id % 5 = 1 end as frozen_semen,
  case when id % 10 = 5 then null else id % 6 = 1 end as artificial_insemination,
  case when id % 10 = 6 then null else id % 9 = 1 end as is_new,
  id % 5 = 0 as has_conflicts,
  case when id % 3 = 1 then null else date_of_birth + cast(3000 + id % 900 as int) end as date_of_death,
  date '2024-01-01' + cast(id % 365 as int) as modified_at,
  cast(year(date_of_birth) as int) as year_of_birth,
  case when id % 3 = 0 then concat('note ', cast(id as string)) else null end as notes
from registry_named n
"""

VIEWS["breeder"] = """
select s_suppkey as id, concat('Kennel ', s_name) as name, md5(concat('b_', s_name)) as uuid, s_suppkey % 3 <> 0 as is_breeder from supplier
"""

VIEWS["dog_breeder"] = """
select distinct o_custkey + 1 as dog_id, l_suppkey as breeder_id from lineitem join orders on l_orderkey = o_orderkey where l_linenumber % 2 = 0
"""

VIEWS["sibling_link"] = """
select a.id as dog_id, b.id as sibling_id from registry a join registry b
  on a.sire_id = b.sire_id and a.dam_id = b.dam_id and a.date_of_birth = b.date_of_birth where a.id < b.id
"""

# One row per changed field of one resolution.
VIEWS["merge_log"] = """
select d.rec_id as log_id, d.rec_id as dog_id, f.field,
  case when f.field = 'color' then r.color else r.land_of_birth end as old_value,
  case when f.field = 'color' then d.color else d.land_of_birth end as new_value
from incoming d join registry r on r.id = d.rec_id
cross join (select 'color' as field union all select 'land_of_birth') f
"""

VIEWS["feed_json"] = """
select cast(floor(id / 25) as bigint) as batch_id, id, concat('{"uuid":"', case when id % 40 = 0 then '' else uuid end, '","registered_name":"', registered_name, '","sex":', cast(sex as string),
  ',"year_of_birth":"', case when id % 9 = 0 then '' else cast(year(date_of_birth) as string) end, '","date_of_birth":"', cast(day(date_of_birth) as string), '/', cast(month(date_of_birth) as string), '/', cast(year(date_of_birth) as string),
  '","weight":"', case when id % 5 = 0 then ' ' else cast(id % 40 as string) end, '","registration_number":"AB ', cast(id as string), '  C","coi":"0.', cast(1 + id % 8 as string),
  '","land_of_birth":"', land_of_birth, '","neutered":', case when neutered then 'true' else 'false' end,
  ',"primary_photo_path":"', case when id % 7 = 0 then '' else concat('p', cast(id as string), '.jpg') end, '","modified_at":"', cast(1 + id % 12 as string), '/', cast(1 + id % 28 as string), '/2024, 08:', cast(10 + id % 50 as string), '"}') as animal
from registry
"""

VIEWS["script_pages"] = """
select id as page_id, concat('<html><script>var animal = {"uuid":"', uuid, '","sex":', cast(sex as string), ',"color":"', coalesce(color, ''), '"};
var health_screenings = [{"name":"HIP","screening_test_result":"', case when id % 3 = 0 then '' else 'A' end, '","notes":""}];
var animal_healthinfos = [{"name":"DM","screening_test_result":"', case when id % 4 = 0 then '' else 'clear' end, '","notes":"', case when id % 5 = 0 then concat('n', cast(id as string)) else '' end, '"},{"name":"PRA","screening_test_result":"carrier","notes":""}];
var siblings = [{"uuid":"s', cast(id % 9 as string), '"},{"uuid":"t', cast(id % 7 as string), '"}];
var litters = {"litters":[{"id":', cast(id as string), ',"date_of_birth":"5/12/2020","litter_male_count":', cast(id % 4 as string), ',"dam":{"id":', cast(id + 1 as string), '},"sire":{"id":', cast(id + 2 as string), '}}]};</script></html>') as html from registry
"""

VIEWS["person_pages"] = """
select id as page_id, concat('<div class="generalInfo"><div class="textRow"><div class="textLabel">Владелец:</div><div class="textDescription"><a href="u.php?id=', cast(id as string), '"> Own ', cast(id % 7 as string), ' </a>, <a href="http://x/', cast(id % 5 as string), '">Co ', cast(id % 5 as string), '</a></div></div>',
  '<div class="textRow"><div class="textLabel">Заводчик:</div><div class="textDescription"><a href="k.php?id=', cast(id % 11 as string), '">Kennel ', cast(id % 11 as string), '</a></div></div></div>',
  '<div class="siblings"><a href="details.php?name=s', cast(id % 6 as string), '">S</a><a href="details.php?name=s', cast(id % 4 as string), '">T</a></div>',
  '<div class="children"><a href="http://x/details.php?name=c', cast(id as string), '">C</a></div>') as html from registry
"""

VIEWS["listing_pages"] = """
select cast(floor(id / 10) as bigint) as page_id, id, concat('<tr><td><a href="details.php?name=d', cast(id - id % 2 as string), '">', case when id % 9 = 0 then '12/?' else registered_name end, '</a></td><td>', case when sex = 1 then 'Male' else 'Female' end, '</td><td>', coalesce(sire_name, ''), '</td><td>', coalesce(dam_name, ''),
  '</td><td>-</td><td>', case when id % 4 = 0 then '' else cast(year(date_of_birth) as string) end, '</td>', case when id % 13 = 0 then '' else '<td>x</td>' end, '</tr>') as row_html from registry_named
"""

VIEWS["wide_listing_pages"] = """
select id as page_id, concat('<table><tr class="legenda"><td>1</td><td>2</td><td><a href="details.php?id=1">legend</a></td><td>4</td><td>5</td><td>6</td><td>7</td><td>8</td><td>9</td><td>10</td><td>11</td></tr><tr class="r"><td>JR ', cast(id as string), '</td><td></td><td><a href="details.php?id=', cast(id - id % 3 as string), '">', case when id % 8 = 0 then ' ' else registered_name end,
  '</a></td><td>4</td><td>5</td><td>6</td><td>7</td><td>8</td><td>9</td><td>10</td>', case when id % 6 = 0 then '' else '<td>11</td>' end, '</tr></table>') as html from registry
"""

VIEWS["card_pages"] = """
select id as page_id, concat('<div class="itemBox"><a class="profilePhoto" href="/animal/view/dog-', cast(id as string), case when id % 10 = 0 then '' else concat('-', substr(md5(cast(id as string)), 1, 8), '-', substr(md5(cast(id as string)), 9, 4), '-', substr(md5(cast(id as string)), 13, 4), '-', substr(md5(cast(id as string)), 17, 4), '-', substr(md5(cast(id as string)), 21, 12)) end, '"></a>',
  '<a class="registeredNameLink"><span class="prefixTitles">', case when id % 3 = 0 then 'CH' else '' end, '</span><span data-bind="text: registered_name">', registered_name, '</span><span class="suffixTitles">', case when id % 4 = 0 then 'JW' else '' end, '</span></a>',
  '<i class="', case when sex = 1 then 'icon-male' else 'icon-female' end, '"></i><div class="italic"><span>', coalesce(sire_name, ''), '</span><span> x </span><span>', coalesce(dam_name, ''), '</span></div>',
  '<span data-bind="text: color">', coalesce(color, ''), '</span><div><span data-bind="text: land_of_birth">', land_of_birth, '</span><span data-bind="text: year_of_birth"> ', cast(year(date_of_birth) as string), '</span></div>',
  '<span class="dateModified">', cast(1 + id % 28 as string), '/6/2025, 20:24</span>', case when id % 5 = 0 then '<div class="ribbon">new</div>' else '' end, '</div>') as html from registry_named
"""

VIEWS["record_pages"] = """
select id as page_id, concat('<div class="sadrzaj"><h2>', registered_name, '</h2><table class="podaci"><tr><td>Reg.No:</td><td>JR ', cast(id as string), '</td></tr><tr><td>Name:</td><td>X (', coalesce(call_name, 'none'), ')</td></tr><tr><td>Sex:</td><td>', case when sex = 1 then 'male' else 'female' end,
  '</td></tr><tr><td>Colour:</td><td>', coalesce(color, ''), '</td></tr><tr><td>Born:</td><td>', lpad(cast(1 + id % 28 as string), 2, '0'), '.05.2020.</td></tr><tr><td>Owner:</td><td><a href="o.php?id=', cast(id % 30 as string), '">Owner ', cast(id % 30 as string), '</a></td></tr><tr><td>CH-titles:</td><td>CH ', cast(id % 4 as string), '</td></tr>',
  case when id % 2 = 0 then '<tr><td>Results:</td><td>BOB</td></tr>' else '' end, '<tr><td>Height:</td><td>', case when id % 6 = 0 then 'tall' else cast(50 + id % 12 as string) end, '</td></tr><tr><td>only one</td></tr></table>',
  '<td class="right"><a onclick="photo(1, ', cast(100 + id as string), ', 3)">a</a><a onclick="photo(2,', cast(200 + id as string), ',4)">b</a><a onclick="other(3, 4, 5)">c</a></td><h3 class="result"><span id="result">F = ', cast(id % 30 as string), '.5%</span></h3></div>') as html from registry
"""

VIEWS["ancestor_pages"] = """
select id as page_id, concat('<table class="pedigre"><tr><td rowspan="4"><a href="details.php?id=', cast(coalesce(sire_id, 9) as string), '">', coalesce(sire_name, 'unknown'), '</a></td><td rowspan="2">x</td></tr><tr><td rowspan="2">y</td></tr><tr><td rowspan="4"><a href="details.php?id=', cast(coalesce(dam_id, 8) as string), '">', coalesce(dam_name, 'unknown'), '</a></td><td rowspan="2">z</td></tr></table>') as html from registry_named
"""

VIEWS["offspring_pages"] = """
select coalesce(dam_id, 0) as page_id, id, concat('<h3>Offspring</h3><table><tr class="legenda"><td>a</td><td>b</td><td><a href="details.php?id=3">L</a></td><td>d</td><td>e</td><td>01.01.2001.</td></tr><tr><td>JR ', cast(id as string), '</td><td></td><td><a href="details.php?id=', cast(id as string), '">', registered_name, '</a></td><td><img src="sp', cast(sex as string), '.gif"></td><td><img class="boja" alt="', coalesce(color, ''), '"></td><td>', case when id % 6 = 0 then '' else concat(lpad(cast(day(date_of_birth) as string), 2, '0'), '.', lpad(cast(month(date_of_birth) as string), 2, '0'), '.', cast(year(date_of_birth) as string), '.') end,
  '</td><td>g</td><td>h</td><td>i</td>', case when sire_id is null then '' else concat('<td><a href="details.php?id=', cast(sire_id as string), '">', coalesce(sire_name, ''), '</a></td>') end, '</tr></table>') as html from registry_named
"""

VIEWS["table_pages"] = """
select id as page_id, concat('<table><tr><td>Name</td><td>Value</td></tr><tr><td>a', cast(id as string), '</td><td> v ', cast(id % 5 as string), ' </td></tr><tr><td>short</td></tr><tr><td>b</td><td>', cast(id % 3 as string), '</td></tr></table>') as html from registry
"""

VIEWS["listing_url"] = """
select o_orderkey as id, case when o_orderkey % 3 = 0 then concat('http://x/results.php?mode=advanced&start=', cast(o_orderkey as string), '&photos=photos')
  when o_orderkey % 3 = 1 then 'http://x/results.php?mode=advanced&name=&photos=photos' else concat('http://x/results.php?start=', cast(o_orderkey % 500 as string)) end as url from orders
"""

# A page of candidates per target name: the name itself with one or four wrong characters, or another name.
VIEWS["name_candidates"] = """
select id, registered_name as target, 1 as position, concat('Other ', substr(registered_name, 8)) as candidate from registry
union all select id, registered_name, 2, concat(substr(registered_name, 1, 18), '~') from registry where id % 2 = 0
union all select id, registered_name, 3, concat(' ', upper(substr(registered_name, 1, 17)), '~~') from registry where id % 3 = 0
union all select id, registered_name, 4, concat(substr(registered_name, 1, 18), '#') from registry
"""


def _used(sql: str, names: list[str]) -> list[str]:
    return [n for n in names if re.search(rf"\b{n}\b", sql)]


def needed_views(sql: str) -> list[str]:
    """Views a statement depends on, directly or not, in definition order."""
    wanted: set[str] = set()
    pending = _used(sql, list(VIEWS))
    while pending:
        name = pending.pop()
        if name not in wanted:
            wanted.add(name)
            pending += _used(VIEWS[name], list(VIEWS))
    return _dependency_order(wanted)


def _dependency_order(wanted: set[str]) -> list[str]:
    ordered: list[str] = []

    def place(name: str) -> None:
        if name in ordered:
            return
        for other in _used(VIEWS[name], list(VIEWS)):
            if other != name:
                place(other)
        ordered.append(name)

    for name in sorted(wanted):
        place(name)
    return ordered


def with_views(body: str, extra: dict[str, str] | None = None, recursive: bool = False) -> str:
    """A self-contained statement: the view bodies it needs, then `extra` clauses, then the body."""
    extra = extra or {}
    names = needed_views(" ".join([body, *extra.values()]))
    clauses = [f"{n} as ({VIEWS[n].strip()})" for n in names]
    clauses += [f"{n} as ({sql.strip()})" for n, sql in extra.items()]
    if not clauses:
        return body.strip()
    keyword = "with recursive" if recursive else "with"
    return f"{keyword} " + ",\n".join(clauses) + "\n" + body.strip()


class Tables:
    """Driver tables and derived views as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._stored: dict[str, DataFrame] = {}

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def sql(self, body: str) -> DataFrame:
        statement = with_views(body)
        bases = [
            f"{n} as (select * from parquet.`{self.folder}/{n}.parquet`)"
            for n in _used(re.sub(r"'[^']*'", "", statement), BASE_TABLES)
        ]
        head = "with " + ", ".join(bases)
        rest = statement[len("with "):] if statement.startswith("with ") else None
        return self.spark.sql(f"{head}, {rest}" if rest else f"{head} {statement}")

    def stored(self, name: str) -> DataFrame:
        """The view written once below the shared folder, for jobs that read it many times."""
        if name not in self._stored:
            self._stored[name] = settle(self(name))
        return self._stored[name]

    def __call__(self, name: str) -> DataFrame:
        return self.sql(f"select * from {name}")
