"""SQL twins of the registered queries, for DuckDB over the same tables."""

from __future__ import annotations

from larder.schemas import SCHEMAS
from larder.sources import sitemaps as SM

_RECIPES = """recipes as (
  select o_orderkey as id, cast(o_custkey % 5 + 1 as int) as source_id, cast(o_custkey as varchar) as source_external_id,
    'https://shop.example.org/de/rezepte/' || o_orderkey as source_url,
    'Plat ' || (o_custkey % 97) || ' préparé ' || lower(substring(o_orderpriority, 3)) as title,
    case o_custkey % 3 when 0 then 'de' when 1 then 'fr' else 'it' end as language,
    o_custkey % 8 + 1 as servings, 5 + o_orderkey % 90 as total_minutes,
    case when 5 + o_orderkey % 90 <= 30 then 'easy' when 5 + o_orderkey % 90 <= 60 then 'medium' else 'advanced' end as difficulty,
    case o_custkey % 4 when 0 then 'swiss' when 1 then 'italian' when 2 then '' end as cuisine,
    case o_custkey % 5 when 0 then 'main' when 1 then 'starter' when 2 then 'dessert' when 3 then 'side' end as course,
    6 - cast(substring(o_orderpriority, 1, 1) as int) as owner_rating, o_totalprice > 400000 as starred,
    o_custkey % 7 as times_cooked,
    case when o_orderstatus <> 'P' or o_custkey % 2 = 0 then cast(o_orderdate as date) end as last_cooked_on,
    case o_orderstatus when 'O' then 'active' when 'F' then 'deleted' else 'draft' end as status,
    case when o_totalprice > 250000 then 'beef' end as primary_protein,
    case when o_totalprice > 300000 then 'heavy' else 'light' end as weight_class,
    case when o_custkey % 2 = 0 then ['vegan', 'quick'] end as dietary_flags,
    case when o_custkey % 3 = 0 then ['nut', 'light'] end as food_groups
  from orders)"""
_LINES = """lines as (
  select l_orderkey as recipe_id, l_linenumber as seq, case when l_returnflag <> 'R' then l_partkey end as ingredient_id,
    'Part ' || (l_partkey % 50) as raw_text, l_quantity as quantity, case when l_linestatus = 'F' then 'g' else 'ml' end as unit,
    case when l_tax > 0.05 then 'gehackt' end as prep_note, l_tax = 0.08 as optional,
    case when l_linenumber <= 3 then 'Teig' when l_linenumber <= 5 then 'Sauce' end as group_label
  from lineitem)"""
_PARTS = """parts as (
  select p_partkey as id, replace(p_name, ' ', '-') || '-' || p_partkey as key, p_name as display_de, lower(p_type) as category,
    p_size, [lower(p_type), split_part(p_name, ' ', 1)] as pairing_tags from part)"""
_PANTRY = """pantry as (
  select p_partkey as ingredient_id, cast(p_size as double) as approx_quantity,
    case when p_size % 2 = 0 then 'g' else 'ml' end as unit, case when p_size <= 10 then 'fridge' else 'pantry' end as location,
    date '2024-01-01' as updated_on
  from part where p_size <= 20)"""
_LOG = """cook_log as (
  select event_id as id, user_id as recipe_id, cast(ts as date) as cooked_on, cast(floor(value) as bigint) % 6 + 1 as servings,
    case when event_type = 'purchase' then cast(floor(value) as bigint) % 5 + 1 end as rating, event_type as notes, ts as logged_at
  from events)"""
_TAGS = """tags as (
  select distinct list_position(['ECONOMY', 'LARGE', 'MEDIUM', 'PROMO', 'SMALL', 'STANDARD'], p_type) as id,
    lower(p_type) as key, p_type as display, 'free' as facet from part)"""
_RECIPE_TAGS = """recipe_tags as (
  select distinct l_orderkey as recipe_id, list_position(['ECONOMY', 'LARGE', 'MEDIUM', 'PROMO', 'SMALL', 'STANDARD'], p_type) as tag_id
  from lineitem join part on p_partkey = l_partkey)"""
_PROMOTIONS = """promotions as (
  select l_orderkey * 1000000000 + l_linenumber * 100000000 + l_partkey as id, l_suppkey as retailer_id,
    'Item ' || (l_partkey % 100) as product_name, l_returnflag as brand, l_extendedprice * (1 - l_discount) as price_chf,
    l_extendedprice as regular_price_chf, 100 * l_discount as discount_pct, cast(l_shipdate as date) as valid_from,
    cast(l_shipdate as date) + 14 as valid_to, l_partkey as ingredient_id from lineitem)"""
_STAPLES = (
    "('salt'), ('pepper'), ('black-pepper'), ('olive-oil'), ('sunflower-oil'), ('rapeseed-oil'), ('water'), ('sugar'), ('flour'), ('butter')"
)


def _with(*parts: str) -> str:
    return "with " + ",\n".join(parts) + "\n"


def _available(*extras: str) -> str:
    given = _STAPLES + "".join(f", ('{e}')" for e in extras)
    return (
        "available as (select key from parts where id in (select ingredient_id from pantry)"
        f" union select k from (values {given}) v(k))"
    )


_KEYS = "part_keys as (select recipe_id, seq, coalesce(key, lower(raw_text)) as key from lines left join parts on parts.id = ingredient_id)"


def _coverage(limit: int | None, missing_ok: int, time: str) -> str:
    return (
        _with(_RECIPES, _LINES, _PARTS, _PANTRY, _KEYS, _available("part 7", "part 11", "part 23", "part 42"))
        + f""", c as (
  select recipe_id, count(*) as ingredient_count, count(a.key) as covered, count(*) - count(a.key) as missing,
    coalesce(string_agg(case when a.key is null then k.key end, '|' order by seq, k.key), '') as missing_ingredients
  from part_keys k left join available a on a.key = k.key group by recipe_id)
select id, title, total_minutes, ingredient_count, covered, missing, missing_ingredients,
  round(covered / ingredient_count, 3) as coverage_score,
  round(round(covered / ingredient_count, 3) - missing * 0.1::double, 3) as score
from c join recipes on id = recipe_id where status = 'active' and missing <= {missing_ok} {time}
order by score desc, id {f"limit {limit}" if limit else ""}"""
    )


def _rotation(min_rating: int, days: int, limit: int | None) -> str:
    post = f"limit {limit}" if limit else ""
    return (
        _with(_RECIPES)
        + f""", c as (select * from recipes where owner_rating >= {min_rating} and status = 'active'),
d as (select *, datediff('day', last_cooked_on, date '2001-08-02') as days_since_cooked from c)
select id, owner_rating, times_cooked, days_since_cooked,
  round((owner_rating - 1) / 4.0::double * 0.6::double + case when days_since_cooked is null then 1.0::double
    when days_since_cooked >= {days} then least(1.0::double, days_since_cooked / {days * 2}.0::double) else 0.0::double end * 0.4::double, 3) as score
from d order by score desc, owner_rating desc, last_cooked_on asc nulls first, id {post}"""
    )


def _easy(minutes: int, parts: int, days: int, limit: int | None, title: str) -> str:
    return (
        _with(_RECIPES, _LINES)
        + f""", c as (select r.id, r.title, r.total_minutes, r.difficulty, r.last_cooked_on, count(l.recipe_id) as ingredient_count
  from recipes r left join lines l on l.recipe_id = r.id where total_minutes <= {minutes} and status = 'active'
  group by all having count(l.recipe_id) <= {parts})
select id, {title} total_minutes, difficulty, ingredient_count,
  round(greatest(0.0::double, 1 - total_minutes / {minutes}.0::double) + greatest(0.0::double, 1 - ingredient_count / {parts}.0::double)
    + case when last_cooked_on is null then 0.5::double when last_cooked_on < date '2001-08-02' - {days} then 0.3::double else 0.0::double end
    + case difficulty when 'easy' then 0.2::double when 'advanced' then -0.2::double else 0.0::double end, 3) as score
from c order by score desc, id {f"limit {limit}" if limit else ""}"""
    )


_OFFERS = """offers as (
  select ingredient_id, count(*) as n_offers, min(struct_pack(p := price_chf, i := id, r := retailer_id, d := discount_pct)) as best
  from promotions where date '1998-06-15' between valid_from and valid_to group by ingredient_id)"""

_FOLD = "lower(strip_accents({}))"
_SLUG = "regexp_replace(regexp_replace(lower({}), '[^a-z0-9äöüéèà-]+', '-', 'g'), '^-+|-+$', '', 'g')"

_DECIDED = """raw as (
  select list_position(['de', 'en', 'es', 'fr'], lang) as source_id, doc_id as position, 'https://docs.example.org/' || doc_id as url,
    lang, doc_id % 41 = 0 as error, {content} as content
  from documents),
stored as (select case when position % 20 = 0 then url else 'https://docs.example.org/old' end as url, content from raw where position % 10 = 0),
own as (
  select *, case when url in (select url from stored) then 'known' when error then 'error'
    when {language} then 'language'{invalid} end as own from raw),
firsts as (
  select content, min(struct_pack(s := source_id, p := position)) as f from own where own is null group by content),
decided0 as (
  select o.source_id, o.position, coalesce(own, case when f.content is not null and o.content not in (select content from stored) then 'new' end,
    'duplicate') as disposition
  from own o left join firsts f on f.content = o.content and f.f.s = o.source_id and f.f.p = o.position)"""

#: Content of whole texts; where records are validated, a text without a word has neither lines nor steps.
_CONTENT = {"content": "lang || chr(31) || 'doc' || chr(31) || replace(text, '.', chr(10)) || chr(31) || text", "invalid": ""}
_WORDLESS = r"(text is null or not regexp_matches(text, '[^\x00-\x20]'))"
_VALIDATED = {
    "content": f"case when {_WORDLESS} then lang || chr(31) || 'doc' || chr(31) || chr(31) else {_CONTENT['content']} end",
    "invalid": " when content = lang || chr(31) || 'doc' || chr(31) || chr(31) then 'invalid'",
}

_TITLES = """['Rindssteak mit Pesto', 'Zitronentorte', 'Pad Thai mit Poulet', 'Quinoasalat', 'Spaghetti Carbonara', 'Avocado-Dip',
    'Gemüseauflauf', 'Birchermüesli', 'Zürcher Geschnetzeltes', 'Currywurst', 'Etwas ganz anderes']"""
_TITLE_COURSES = "['main', 'bake', 'main', 'starter', null, 'side', 'main', 'breakfast', 'main', null, null]"
_TITLE_CUISINES = "['italian', null, 'thai', null, 'italian', null, null, 'swiss', 'swiss', null, null]"
_COURSE = f"""case when o % 8 = 0 then 'main' when o % 10 = 0 then 'dessert' else coalesce({_TITLE_COURSES}[o % 11 + 1],
    case when o % 10 = 1 then 'main' end) end"""
_CUISINE = f"""case when o % 12 = 0 then 'italian' else coalesce({_TITLE_CUISINES}[o % 11 + 1],
    case when o % 9 = 0 then 'japanese' end{{}}) end"""
_METHOD = """case when o % 4 = 0 or o % 10 = 1 and o % 4 in (0, 3) then 'grilled' when o % 10 = 1 and o % 4 = 1 then 'grilled'
    when o % 10 = 1 and o % 4 = 2 then 'grilled' when o % 4 = 1 then 'baked' when o % 4 = 2 then 'braised' end"""

_FOOD = """food as (
  select p_partkey as id, p_type = 'SMALL' and p_size <= 25 as sweet, p_size = 50 as animal_name,
    case p_type when 'ECONOMY' then 'meat' when 'LARGE' then 'fish' when 'MEDIUM' then 'dairy' when 'PROMO' then 'vegetable' else 'other' end as cat,
    case p_type when 'ECONOMY' then ['beef', 'poultry', 'pork', null][p_size % 4 + 1] when 'LARGE' then ['fish', 'seafood'][p_size % 2 + 1] end as protein,
    p_type = 'MEDIUM' and p_size % 2 = 0 as heavy, case p_size % 3 when 0 then 'nut' when 2 then 'grain' end as food_group from part),
fl as (
  select l_orderkey as rid, l_quantity as q, l_linenumber > 3 as known, case when l_linenumber > 3 then l_partkey end as pid, l_partkey % 6 as t from lineitem),
prof as (
  select rid, count(*) as n, count_if(known) as n_known, count_if(known and sweet) as n_sweet,
    coalesce(bool_or(known and cat in ('meat', 'fish')), false) as animal, coalesce(bool_or(known and cat = 'dairy'), false) as dairy,
    coalesce(bool_or(known and cat in ('meat', 'fish', 'vegetable')), false) as savoury, coalesce(bool_or(known and heavy), false) as heavy,
    coalesce(bool_or(known and animal_name), false) or coalesce(bool_or(not known and t <= 2), false) as animal_word,
    list_sort(list(distinct case when not known then case t when 0 then 'poultry' when 1 then 'fish' when 2 then 'beef' end end)
      filter (where not known and t <= 2)) as words,
    list_sort(list(distinct food_group) filter (where food_group is not null and known)) as groups
  from fl left join food on food.id = pid group by rid),
w as (select rid, protein, sum(q) as w from fl join food on food.id = pid where protein is not null group by rid, protein),
wr as (select rid, list(struct_pack(w := w, p := protein) order by w desc, protein desc) as ws from w group by rid),
pp as (
  select o_orderkey as o, prof.*, case when coalesce(animal, false) then case len(ws) when 1 then ws[1].p else
      case when ws is not null then case when ws[1].w > 2 * ws[2].w then ws[1].p else 'mixed' end end end
    else case when len(words) = 1 then words[1] when len(words) > 1 then 'mixed' end end as protein
  from orders left join prof on rid = o_orderkey left join wr on wr.rid = o_orderkey)"""


_INGESTED = f"""r as (
  select o_orderkey as o, o_custkey % 5 + 1 as source_id, o_custkey as ware, o_orderkey % 11 as t,
    case when o_orderkey % 6 <= 1 then o_orderkey % 6 else 2 end as second, o_orderkey % 4 as step,
    case when o_orderkey % 10 = 0 and o_orderkey % 9 <> 0 then 'known' when o_orderkey % 97 = 0 then 'error'
      when o_orderkey % 13 = 0 then 'language' end as own from orders),
firsts as (select min(struct_pack(s := source_id, o := o)).o as o from r where own is null group by t, second, ware, step),
fresh as (
  select r.*, (select max(o_orderkey) from orders where o_orderkey % 10 = 0) + row_number() over (order by source_id, o) as id,
    nullif(o % 70, 0) as minutes from r where o in (from firsts)),
cat as (select p_partkey as ware, p_partkey as ware_id from part where p_partkey % 3 <> 0),
x as (select fresh.*, ware_id, {_COURSE} as course, {_CUISINE.format(", case when o % 6 = 0 then 'asian' end")} as cuisine,
  {_METHOD} as cooking_method from fresh left join cat using (ware))
"""


def statements() -> dict[str, str]:
    names = "(select p_name, min(p_partkey) as id from part group by p_name)"
    decided = _DECIDED.format(language="lang not in ('de', 'en', 'fr')", **_CONTENT)
    decided_all = _DECIDED.format(language="false", **_CONTENT)
    validated = _DECIDED.format(language="lang not in ('de', 'en', 'fr')", **_VALIDATED)
    validated_all = _DECIDED.format(language="false", **_VALIDATED)
    line_cte = """l as (
  select l_orderkey as recipe_id, l_linenumber as seq, l_partkey as part, l_quantity as quantity,
    case l_linenumber % 4 when 0 then 'g' when 1 then 'EL' when 2 then 'dl' else 'Prise' end as unit,
    case l_linenumber % 3 when 0 then 'frische ' when 1 then 'grob gehackte ' else '' end as qualifier,
    case when l_tax = 0.0 then 'Xylophon ' || (l_orderkey % 7) when l_partkey % 4 = 0 then p_name || 'n' else p_name end as name,
    case l_returnflag when 'A' then 'in Streifen' when 'N' then 'fein' end as prep_note, l_tax, p_name
  from lineitem join part on p_partkey = l_partkey)"""
    sections = f"""dl as (
  select id as recipe_id, 0 as section, 0 as seq, 0 as sub, '# ' || title as line from recipes
  union all select id, 2, i - 1, 0, x[i] from (select id, ['## Metadata', '', '- **Servings:** ' || servings, '- **Total time:** ' || total_minutes || ' min',
      '- **Difficulty:** ' || difficulty] || case when course is null then [] else ['- **Course:** ' || course] end
      || case when coalesce(cuisine, '') = '' then [] else ['- **Cuisine:** ' || cuisine] end as x from recipes), unnest(range(1, len(x) + 1)) t(i)
  union all select id, 3, i - 1, 0, x[i] from (select id, ['## Source', '', '- **Source ID:** ' || source_id] as x from recipes), unnest(range(1, 4)) t(i)
  union all select id, 6, i - 1, 0, ['## Notes', ''][i] from recipes, unnest(range(1, 3)) t(i)
  union all select id, 7, i - 1, 0, ['## Cook log', '', ''][i] from recipes, unnest(range(1, 4)) t(i)
  union all select recipe_id, 4, i - 1, 0, ['## Ingredients', ''][i] from (select distinct recipe_id from lines), unnest(range(1, 3)) t(i)
  union all select id, 5, i - 1, 0, ['## Steps', ''][i] from recipes, unnest(range(1, 3)) t(i)
  union all select recipe_id, 4, seq + 1, 0, '- ' || raw_text || case when prep_note is null then '' else ', ' || prep_note end
      || case when optional then ' *(optional)*' else '' end from lines
  union all select recipe_id, 4, seq + 1, sub, case when sub = -2 then '**' || group_label || '**' else '' end from (
      select recipe_id, seq, group_label, lag(group_label) over (partition by recipe_id order by seq, group_label) as before
      from lines where group_label is not null), unnest([-3, -2, -1]) t(sub)
      where (before is null or before <> group_label) and (sub > -3 or before is not null)
  union all select id, 5, i + 1, 0, i || '. ' || ['Mix for ' || (servings0 % 9) || ' min.', 'Serve.'][i]
      from (select o_orderkey as id, o_custkey as servings0 from orders), unnest(range(1, 3)) t(i)),
dn as (select *, row_number() over (partition by recipe_id order by section, seq, sub, line) as n from dl)"""
    sql = {
        "coverage_ranking": _coverage(25, 2, ""),
        "coverage_all": _coverage(None, 1, "and total_minutes <= 60"),
        "rotation_ranking": _rotation(3, 365, 20),
        "rotation_all": _rotation(2, 900, None),
        "easy_ranking": _easy(30, 8, 500, 20, "title,"),
        "easy_all": _easy(70, 5, 900, None, ""),
        "available_keys": _with(_PARTS, _PANTRY, _available("part 7")) + "select key from available",
        "part_key_chunks": _with(_LINES, _PARTS, _KEYS)
        + """, n as (select *, row_number() over (partition by recipe_id order by seq, key) as n from part_keys)
select recipe_id, (n - 1) // 1000 as chunk, string_agg(key, '|' order by n) as keys from n group by all""",
        "pairing_tag_ranking": _with(_RECIPES, _LINES, _PARTS)
        + """, t as (select distinct recipe_id, unnest(pairing_tags) as tag from lines join parts on parts.id = ingredient_id)
select recipe_id, count(*) as overlap, title from t join recipes on recipes.id = recipe_id
where tag in ('promo', 'hot', 'red', 'small') and status = 'active' group by recipe_id, title order by overlap desc, recipe_id limit 30""",
        "promotion_value_ranking": _with(_RECIPES, _LINES, _PROMOTIONS, _OFFERS)
        + """select recipe_id, title, count(*) as n_on_offer, round(sum(best.d), 3) as value
from lines join offers using (ingredient_id) join recipes on recipes.id = recipe_id where status = 'active'
group by recipe_id, title order by value desc, recipe_id limit 30""",
        "shopping_list": _with(_RECIPES, _LINES, _PARTS, _PANTRY)
        + """, need as (select ingredient_id, unit, sum(quantity * 2) as needed from lines
  where recipe_id in (select id from recipes where starred) and ingredient_id is not null group by all)
select n.ingredient_id, n.unit, needed, coalesce(approx_quantity, 0) as in_stock, needed - coalesce(approx_quantity, 0) as to_buy, key, category
from need n left join pantry p on p.ingredient_id = n.ingredient_id and p.unit = n.unit left join parts on parts.id = n.ingredient_id
where needed > coalesce(approx_quantity, 0)""",
        "find_by_text": _with(_RECIPES)
        + f"""select id, title, total_minutes, difficulty, course, language from recipes
where {_FOLD.format('title')} like '%prepare low%' and language = 'de' and total_minutes <= 45 and difficulty = 'easy' order by title, id limit 20""",
        "find_by_tags": _with(_RECIPES, _TAGS, _RECIPE_TAGS)
        + """select id, title, total_minutes, difficulty, course, language from recipes where course = 'main' and id in (
  select recipe_id from recipe_tags join tags on tags.id = tag_id where key in ('promo', 'small', 'economy')
  group by recipe_id having count(distinct key) = 3)""",
        "find_without_tags": _with(_RECIPES, _TAGS, _RECIPE_TAGS)
        + """select id, title, total_minutes, difficulty, course, language from recipes where status = 'active'
and id in (select recipe_id from recipe_tags join tags on tags.id = tag_id where key = 'promo')
and id not in (select recipe_id from recipe_tags join tags on tags.id = tag_id where key in ('small', 'large'))""",
        "all_of_tags": _with(_TAGS, _RECIPE_TAGS)
        + """select recipe_id from recipe_tags join tags on tags.id = tag_id where key in ('promo', 'small', 'large', 'economy')
group by recipe_id having count(distinct key) = 4""",
        "search_titles": _with(_RECIPES)
        + f"select id, title, language from recipes where {_FOLD.format('title')} like '%plat 13%' and language = 'fr' order by title, id limit 25",
        "starred_recipes": _with(_RECIPES)
        + "select id, title, total_minutes, difficulty, course, owner_rating, times_cooked from recipes where starred order by title, id limit 50",
        "active_recipes": _with(_RECIPES)
        + "select id, title, language, total_minutes, difficulty, course from recipes where status = 'active'",
        "pantry_contents": _with(_PARTS, _PANTRY)
        + "select ingredient_id, key, display_de, approx_quantity, unit, location from pantry left join parts on parts.id = ingredient_id",
        "tag_listing": _with(_TAGS) + "select * from tags",
        "recent_cook_log": _with(_RECIPES, _LOG)
        + """select c.id, c.recipe_id, title, cooked_on, rating, notes from cook_log c left join recipes r on r.id = c.recipe_id
order by cooked_on desc, c.id desc limit 50""",
        "cook_history": _with(_RECIPES, _LOG)
        + """select c.id, c.recipe_id, title, cooked_on, c.servings, rating, notes from cook_log c join recipes r on r.id = c.recipe_id
order by cooked_on desc, logged_at desc, c.id desc limit 40""",
        "last_events_per_recipe": _with(_LOG)
        + """select recipe_id, id, cooked_on, rating, row_number() over (partition by recipe_id order by cooked_on desc, logged_at desc) as rank
from cook_log qualify rank <= 5""",
        "recipe_details": _with(_RECIPES, _LINES, _LOG)
        + """, w as (select * from recipes where id in (3, 17, 42))
select id as recipe_id, 'details' as section, 0 as seq, 'Title: ' || title as text from w
union all select id, 'details', 1, 'Source: ' || source_url from w union all select id, 'details', 2, 'Servings: ' || servings from w
union all select id, 'details', 3, 'Total minutes: ' || total_minutes from w union all select id, 'details', 4, 'Difficulty: ' || difficulty from w
union all select id, 'details', 5, 'Course: ' || course from w where course is not null
union all select id, 'details', 6, 'Cuisine: ' || cuisine from w where cuisine is not null
union all select recipe_id, 'ingredients', seq, raw_text || coalesce(', ' || prep_note, '') from lines where recipe_id in (3, 17, 42)
union all select o_orderkey, 'steps', i, ['Mix for ' || (o_custkey % 9) || ' min.', 'Serve.'][i] from orders, unnest([1, 2]) t(i) where o_orderkey in (3, 17, 42)
union all select * from (select recipe_id, 'cook history', row_number() over (partition by recipe_id order by cooked_on desc, logged_at desc, id desc) as k,
  concat_ws(' | ', cooked_on, servings || ' servings', rating || '/5', notes) from cook_log where recipe_id in (3, 17, 42)) where k <= 5""",
        "computed_tags": _with(_RECIPES)
        + """select id, array_to_string(list_sort(list_distinct(list_filter([primary_protein, 'savoury', weight_class, course, cuisine, difficulty]
  || coalesce(dietary_flags, []) || coalesce(food_groups, []), lambda x: x is not null and x <> ''))), '|') as computed_tags from recipes""",
        "adhoc_sql": _with(_RECIPES)
        + "select language, course, count(*) as n, min(total_minutes) as fastest from recipes where owner_rating >= 3 group by all",
        "promotions_search": _with(_PROMOTIONS)
        + """select product_name, brand, price_chf, regular_price_chf, discount_pct, valid_from, valid_to from promotions
where discount_pct >= 5.0 and product_name ilike '%ITEM 1%' and retailer_id in (select s_suppkey from supplier where s_name = 'Supplier#000000007')
order by discount_pct desc, id limit 50""",
        "promotions_unexpired": _with(_PROMOTIONS)
        + """select id, product_name, brand, price_chf, regular_price_chf, discount_pct, valid_from, valid_to from promotions
where valid_to >= date '1998-06-15' order by discount_pct desc, id limit 50""",
        "best_offers": _with(_PROMOTIONS, _OFFERS)
        + "select ingredient_id, best.i as promotion_id, best.r as retailer_id, best.p as price_chf, best.d as discount_pct, n_offers from offers",
        "discounts": _with(_PROMOTIONS)
        + """select id, case when id % 11 <> 0 and regular_price_chf > 0
  then round((regular_price_chf - price_chf) / regular_price_chf * 100, 4) end as pct from promotions""",
        "collection_stats": _with(_RECIPES)
        + """select count(*) as total, count_if(status = 'active') as active, count_if(status = 'deleted') as deleted,
  count_if(starred) as starred, avg(total_minutes) as avg_minutes, count(distinct language) as languages, count(distinct course) as courses from recipes""",
        "weekly_trends": _with(_LOG)
        + """select strftime(cooked_on, '%Y-W%W') as period, count(*) as cook_count, count(distinct recipe_id) as unique_recipes
from cook_log where cooked_on >= date '2024-01-31' - interval '3 weeks' group by period""",
        "monthly_trends": """select strftime(o_orderdate, '%Y-%m') as period, count(*) as cook_count, count(distinct o_custkey) as unique_recipes
from orders where cast(o_orderdate as date) >= date '2001-08-02' - interval '30 months' group by period""",
        "top_cooked": _with(_RECIPES, _LOG)
        + """select recipe_id, title, count(*) as cook_count, max(cooked_on) as last_cooked from cook_log c left join recipes r on r.id = c.recipe_id
group by recipe_id, title order by cook_count desc, recipe_id limit 10""",
        "cook_stats": _with(_LOG)
        + """select recipe_id, count(*) as times_cooked, max(cooked_on) as last_cooked_on,
  arg_max(rating, struct_pack(a := cooked_on, b := logged_at, c := id)) filter (where rating is not null) as latest_rating from cook_log group by recipe_id""",
        "cooking_frequency": _with(_RECIPES, _LOG)
        + """select 'trend' as part, strftime(cooked_on, '%Y-W%W') as name, count(*) as cook_count, count(distinct recipe_id) as unique_recipes
from cook_log where cooked_on >= date '2024-01-31' - interval '4 weeks' group by name
union all select * from (select 'top', title, count(*) as n, null from cook_log c left join recipes r on r.id = c.recipe_id
  group by recipe_id, title order by n desc, recipe_id limit 5)""",
        "recipe_full_view": _with(_RECIPES, _LOG)
        + """, s as (select recipe_id, count(*) as n, max(cooked_on) as last,
  arg_max(rating, struct_pack(a := cooked_on, b := logged_at, c := id)) filter (where rating is not null) as rating from cook_log group by recipe_id)
select r.id, title, cuisine, course, coalesce(n, 0) as log_times_cooked, last as log_last_cooked_on, rating as log_latest_rating,
  case o_custkey % 4 when 0 then null when 1 then 'https://shop.example.org/' || r.id || '-3.jpg'
    else 'https://shop.example.org/' || r.id || '-1.jpg' end as primary_image
from recipes r join orders on o_orderkey = r.id left join s on s.recipe_id = r.id""",
        "ingredients_resolved_view": _with(_LINES, _PARTS)
        + """select recipe_id, seq, ingredient_id, raw_text, key as ingredient_key, display_de as ingredient_display_de,
  category as ingredient_category from lines left join parts on parts.id = ingredient_id""",
        "tool_event_stats": """select count(*) as total, count_if(event_type <> 'error') as success, count_if(event_type = 'error') as error,
  round(avg(value), 1) as avg_ms, round(max(value), 1) as max_ms from events""",
        "tool_breakdown": """select event_type as tool, count(*) as calls, count_if(event_type = 'error') as errors, round(avg(value), 1) as avg_ms
from events group by 1""",
        "recent_tool_events": """select event_id, event_type as tool, value as duration_ms, event_type <> 'error' as success,
  case when event_type = 'error' then props end as error from events order by ts desc, event_id limit 20""",
        "row_counts": " union all ".join(
            f"select '{t}' as \"table\", count(*) as rows from {t}"
            for t in ("orders", "lineitem", "part", "events", "documents", "pages")
        ),
        "quality_report": _with(_LOG)
        + """, r as (select o_orderkey as id, o_custkey from orders),
l as (select case when l_linenumber = 7 then -l_orderkey % 97 - 1 else l_orderkey end as k from lineitem)
select 'recipe_required_fields' as "check", cast(id as varchar) as key, 'title' as detail from r where id % 501 = 0
union all select 'recipe_ingredients_fk', cast(k as varchar), 'recipe_id' from (select distinct k from l where k not in (select id from r))
union all select 'cook_log_fk', cast(k as varchar), 'recipe_id' from (select distinct recipe_id as k from cook_log where recipe_id not in (select id from r))
union all select 'duplicate_recipes', (o_custkey % 5 + 1) || '|' || o_custkey, cast(count(*) as varchar) from r group by o_custkey having count(*) > 1""",
        "recipes_without_lines": """select 'orders_without_lines' as "check", cast(o_orderkey as varchar) as key, 'o_orderkey' as detail
from orders where o_orderkey not in (select l_orderkey from lineitem)""",
        "unlabelled_documents": """select distinct 'documents_without_labels' as "check", cast(doc_id as varchar) as key, 'doc_id' as detail
from documents where doc_id not in (select doc_id from labels)""",
        "duplicate_lines": """select 'duplicate_lines' as "check", l_orderkey || '|' || l_linenumber as key, cast(count(*) as varchar) as detail
from lineitem group by l_orderkey, l_linenumber having count(*) > 1""",
        "conformed_recipes": _with(_RECIPES)
        + """select language, owner_rating, starred, count(title) as titles, 0 as scraped, sum(total_minutes) as minutes from recipes group by all""",
        "star_changes": _with(_RECIPES)
        + """, c as (select user_id, arg_max(event_type <> 'error', ts) as s from events group by user_id)
select id, title, case when user_id is not null then s else starred end as starred from recipes left join c on user_id = id""",
        "rating_changes": _with(_RECIPES)
        + """, v as (select user_id, ts, case when event_type <> 'view' then cast(floor(value) as bigint) % 8 end as r from events),
c as (select user_id, arg_max_null(r, ts) as r from v where r is null or r between 1 and 5 group by user_id)
select id, case when user_id is not null then r else owner_rating end as owner_rating from recipes left join c on user_id = id""",
    }
    logged = (
        _with(_RECIPES, _LOG)
        + """, old as (select * from cook_log where logged_at < timestamp '2024-01-20'),
ev as (select case when notes = 'signup' then -recipe_id else recipe_id end as recipe_id, cooked_on, logged_at, notes,
  case when notes = 'click' then 9 else rating end as rating from cook_log where logged_at >= timestamp '2024-01-20'),
chk as (select *, case when recipe_id not in (select id from recipes) then 'unknown recipe' when rating not between 1 and 5 then 'rating out of range' end as reason from ev),
ok as (select * from chk where reason is null),
full_log as (select id, recipe_id, cooked_on, rating, notes, logged_at from old union all
  select (select max(id) from old) + row_number() over (order by logged_at, recipe_id, cooked_on), recipe_id, cooked_on, rating, notes, logged_at from ok),
aff as (select distinct recipe_id from ok)
"""
    )
    sql |= {
        "logged_cooks": logged + "select id, recipe_id, cooked_on, rating, notes from full_log",
        "logged_cook_recipes": logged
        + """, st as (select recipe_id, count(*) as n, max(cooked_on) as d, arg_max(rating, struct_pack(a := cooked_on, b := logged_at, c := id)) filter (where rating is not null) as r
  from full_log where recipe_id in (from aff) group by recipe_id)
select id, coalesce(n, times_cooked) as times_cooked, case when n is null then last_cooked_on else d end as last_cooked_on,
  coalesce(r, owner_rating) as owner_rating from recipes left join st on st.recipe_id = id""",
        "logged_cook_rejects": logged + "select reason, count(*) as n from chk where reason is not null group by reason",
        "logged_cook_pins": logged
        + "select id, id as recipe_id, case when id in (from aff) then 'cooked' else 'pinned' end as status from recipes where starred",
    }
    pins = """pins as (select id, id as recipe_id, title, case when id % 3 = 0 then last_cooked_on end as target_date,
  case when id % 4 = 0 then 'cooked' when id % 7 = 0 then 'dismissed' else 'pinned' end as status from recipes where starred)"""
    sql |= {
        "pin_requests": _with(_RECIPES, pins)
        + """, f as (select user_id, min(struct_pack(t := ts, d := cast(ts as date), n := event_type)) as x from events
  where user_id in (select id from recipes) and user_id not in (select recipe_id from pins where status = 'pinned') group by user_id)
select id, recipe_id, target_date, cast(null as varchar) as note, status from pins
union all select (select coalesce(max(id), 0) from pins) + row_number() over (order by x.t, user_id), user_id, x.d, x.n, 'pinned' from f""",
        "unpin_requests": _with(_RECIPES, pins)
        + """select id, recipe_id, case when status = 'pinned' and recipe_id in (select user_id from events where event_type = 'error')
  then 'dismissed' else status end as status from pins""",
        "pinboard": _with(_RECIPES, pins) + "select id, recipe_id, title, target_date, status from pins",
        "pantry_changes": _with(_PANTRY)
        + """, up as (select l_partkey as k, max(struct_pack(d := l_shipdate, q := l_quantity)) as x from lineitem
  where l_returnflag = 'A' and l_tax <> 0.0 group by l_partkey),
m as (select * from pantry where ingredient_id not in (select k from up)
  union all select k, x.q, 'g', 'fridge', cast(x.d as date) from up)
select * from m where ingredient_id not in (select l_partkey from lineitem where l_returnflag = 'R' and l_tax = 0.08)""",
        "pantry_unknown_keys": _with(_PARTS)
        + "select distinct 'new-' || key as key from lineitem join parts on id = l_partkey where l_returnflag = 'A' and l_tax = 0.0",
        "own_recipes": f"""with e as (select conv_id * 1000 + turn as entry_no, conv_id, turn, text from conversations where turn % 4 <> 2),
n as (select *, (select max(o_orderkey) from orders) + row_number() over (order by entry_no) as id,
  case when conv_id % 3 > 0 then turn + 10 end as p, case when conv_id % 2 > 0 then turn + 20 end as c from e)
select id, 'own-' || id as source_external_id, trim(regexp_replace({_FOLD.format('text')}, '\\s+', ' ', 'g')) as title_normalised,
  p as prep_minutes, c as cook_minutes, coalesce(p + c, p, c) as total_minutes, len(string_split(text, chr(10))) as n_steps from n""",
    }
    assigned = (
        _with(_TAGS, _RECIPE_TAGS)
        + """, a as (select distinct user_id as recipe_id, event_type || '-gr-e-' || (user_id % 5) as k0, event_type, user_id % 5 as n from events
  where user_id in (select o_orderkey from orders)),
b as (select recipe_id, event_type || '-größe-' || n as key0, replace(event_type || '-grö-e-' || n, 'ß', '-') as key from a),
f as (select key, min(recipe_id) as r from b group by key),
nt as (select 6 + row_number() over (order by r, key) as id, key, replace(key, '-', ' ') as display, 'user' as facet from f)
"""
    )
    sql |= {
        "user_tags": assigned + "select id, key, display, facet from nt",
        "user_tag_links": assigned + "select distinct recipe_id, nt.id as tag_id from b join nt using (key)",
        "normalised_texts": f"""select doc_id, sha256(trim(regexp_replace({_FOLD.format('text')}, '\\s+', ' ', 'g'))) as digest from documents""",
        "text_slugs": f"select doc_id, sha256({_SLUG.format('text')}) as digest from documents",
        "keyword_splits": """with k as (select doc_id, list_filter(list_transform(string_split(text, ','), lambda x: trim(x, ' ' || chr(10) || chr(9) || chr(13))),
  lambda x: x <> '') as w from documents) select doc_id, len(w) as n, sha256(array_to_string(w, '|')) as digest from k""",
        "content_first_seen": """select sha256(lang || chr(31) || chr(31) || replace(text, '.', chr(10)) || chr(31) || text) as content_hash,
  min(doc_id) as doc_id, count(*) as copies from documents group by 1""",
        "word_mentions": """with t as (select doc_id, unnest(string_split(regexp_replace(lower(text), '\\s+', ' ', 'g'), ' ')) as w from documents)
, p as (select doc_id, unnest(string_split(regexp_replace(w, '[,.;:()]+$', ''), '-')) as w from t)
select doc_id, coalesce(bool_or(w = 'ung' or regexp_matches(w, '^(heit|tion|lich)|(heit|tion|lich)$')), false) as mentioned from p group by doc_id""",
        "parsed_lines": _with(line_cte)
        + "select recipe_id, seq, part, quantity, unit, qualifier || name as ingredient, prep_note, false as optional from l",
        "resolved_lines": _with(line_cte)
        + """, cat as (select p_name, min(p_partkey) as id from part group by p_name)
select recipe_id, seq, part, qualifier || name as ingredient, case when l_tax <> 0.0 then replace(l.p_name, ' ', '-') end as ingredient_key,
  case when l_tax <> 0.0 then id end as ingredient_id from l join cat using (p_name)""",
        "catalogue_aliases": """with cat as (select p_name, min(p_partkey) as id, replace(p_name, ' ', '-') as key from part group by p_name)
select p_name as alias, key, id from cat union all select p_name || ' extra', key, id from cat union all select key, key, id from cat""",
        "order_durations": """select o_orderkey, case when m between 1 and 10080 then m end as minutes from (select o_orderkey, case o_orderkey % 5
  when 0 then o_orderkey % 7 * 60 + o_orderkey % 50 + cast(o_orderkey % 60 >= 30 as int) when 1 then (o_orderkey % 4 + 1) * 60 + o_orderkey % 50
  when 2 then o_orderkey % 200 when 3 then o_orderkey end as m from orders)""",
        "reconciled_times": """with o as (select o_orderkey, case when o_orderkey % 7 > 0 then o_orderkey % 50 + 1 end as p,
  case when o_orderkey % 3 > 0 then o_custkey % 50 + 1 end as c0, case when o_orderkey % 2 > 0 then o_custkey % 90 end as t from orders),
x as (select o_orderkey, p, case when o_orderkey % 5 = 0 then p else c0 end as c, t from o)
select o_orderkey, p as prep, case when p is not null and (c is null or c = p) then case when t > p then t - p end else c end as cook,
  case when p is not null and (c is null or c = p) then coalesce(t, p) when p is not null then p + c else coalesce(c, t) end as total from x""",
        "page_url_fields": """with u as (select page_id, url, regexp_replace(url, '[?#].*$', '') as bare,
  case when contains(url, '/de/') then 'de' when contains(url, '/fr/') then 'fr' when contains(url, '/it/') then 'it' else 'de' end as language from pages),
s as (select *, list_filter(string_split(bare, '/'), lambda x: x <> '')[-1] as last from u),
e as (select *, regexp_replace(last, '(?i)\\.(html?|php|aspx?)$', '') as slug0 from s)
select page_id, slug0 || case when suffix(slug0, '-' || language) then '' else '-' || language end as external_id, language,
  replace(regexp_extract(regexp_replace(regexp_replace(bare, '^https?://[^/]*', ''), '/+$', ''), '([^/]*)$', 1), '-', ' ') as slug,
  page_id || '_003_' || substring(sha256(url), 1, 12) || '.jpg' as image_key from e""",
        "resized_images": """with x as (select o_orderkey, o_orderkey % 2000 + 1 as w, o_custkey % 1500 + 1 as h,
  case when o_orderkey % 5 = 0 then 'https://img.example.org/' else 'https://recipeimages.migros.ch/' end as host from orders)
select o_orderkey, host || 'crop/v-w-' || case when o_orderkey % 5 <> 0 and w > 1200 then 1200 else w end || '-h-' ||
  case when o_orderkey % 5 <> 0 and w > 1200 then cast(floor(h * (1200.0::double / w)) as bigint) else h end || '-a-center/x.jpg' as url from x""",
        "classified_records": f"""with r as (select o_orderkey as o from orders)
select o as recipe_id, {_COURSE} as course, {_CUISINE.format('')} as cuisine,
  case when o % 5 = 0 then 'advanced' when o % 10 = 2 then 'medium' end as difficulty from r""",
        "cooking_methods": f"with r as (select o_orderkey as o from orders) select o as recipe_id, {_METHOD} as method from r",
        "line_cuisines": "select o_orderkey as recipe_id, case when o_orderkey % 6 = 0 then 'asian' end as cuisine from orders",
        "classified_parts": _with(_FOOD)
        + """, x as (select *, case o % 6 when 0 then 'dessert' when 1 then 'starter' end as course, case o % 5 when 0 then 90 when 1 then 10 end as cook from pp)
select o as recipe_id, protein as primary_protein,
  case when course = 'dessert' then 'sweet' when o % 7 = 0 then case when savoury then 'sweet-savoury' else 'sweet' end
    when n_sweet > 0 and n_sweet >= n_known * 0.3::double then 'sweet' else 'savoury' end as taste_profile,
  case when course = 'starter' then 'light'
    when coalesce(cast(cook > 60 as int), 0) + coalesce(cast(protein in ('beef', 'lamb', 'pork', 'game') as int), 0) + coalesce(cast(heavy as int), 0) + cast(o % 7 = 1 as int) >= 2 then 'heavy'
    when cast(protein is null as int) + coalesce(cast(cook <= 20 as int), 0) + cast(o % 7 = 1 as int) >= 2 then 'light' else 'medium' end as weight_class,
  array_to_string(list_filter([case when ok and not dairy then 'dairy-free' end, case when o % 60 <= 30 then 'quick' end,
    case when ok and not an and not dairy then 'vegan' end, case when ok and not an then 'vegetarian' end], lambda v: v is not null), '|') as dietary_flags,
  array_to_string(coalesce(groups, []), '|') as food_groups
from (select * replace (coalesce(dairy, false) as dairy, coalesce(heavy, false) as heavy), n is null or n_known > 0 as ok,
  coalesce(animal, false) or coalesce(animal_word, false) as an from x)""",
        "keyword_tag_rows": """with m as (select o_orderkey as r, unnest(case when o_orderkey % 10 = 0 then [0, 1] when o_orderkey % 10 = 1 then [2, 3, 4] when o_orderkey % 10 = 2 then [5, 6] end) as p from orders),
k as (select *, ['dessert', 'einfach', 'fleisch', 'grilled', 'für-gäste', 'mittel', 'spanisch-co'][p + 1] as key, ['dessert', 'Einfach', 'Fleisch', 'grilled', 'Für Gäste', 'Mittel', 'Spanisch & Co'][p + 1] as display,
  ['course', 'free', 'ingredient', 'method', 'occasion', 'free', 'free'][p + 1] as facet from m),
f as (select key, display, facet, min(r * 10 + p) as first from k group by all)
select 6 + row_number() over (order by first) as id, key, display, facet from f""",
        "keyword_tag_links": """with m as (select o_orderkey as r, unnest(case when o_orderkey % 10 = 0 then [0, 1] when o_orderkey % 10 = 1 then [2, 3, 4] when o_orderkey % 10 = 2 then [5, 6] end) as p from orders),
f as (select p, min(r * 10 + p) as first, count(*) as n, min(r) as first_recipe from m group by p)
select 6 + row_number() over (order by first) as tag_id, n, first_recipe from f""",
        "classification_tag_rows": _with(_RECIPES, _TAGS)
        + """, m as (select id, unnest(case when dietary_flags is null then [] else [struct_pack(p := 0, k := 'vegan', f := 'dietary'), struct_pack(p := 1, k := 'quick', f := 'dietary')] end
  || [struct_pack(p := 2, k := course, f := 'course'), struct_pack(p := 3, k := difficulty, f := 'difficulty')]) as x from recipes),
f as (select x.k as key, x.f as facet, min(id * 10 + x.p) as first from m where x.k is not null and x.k not in (select key from tags) group by all)
select 6 + row_number() over (order by first) as id, key, key as display, facet from f""",
        "ingest_dispositions": _with(validated) + "select source_id, position, disposition from decided0",
        "ingest_capped": _with(validated_all)
        + """, ranked as (select *, row_number() over (partition by source_id order by position) as n from decided0 where disposition = 'new'),
cut as (select source_id, position as last from ranked where n = 50)
select d.source_id, d.position, case when d.position > last then 'over_limit' else disposition end as disposition from decided0 d left join cut using (source_id)""",
        "ingest_audit": _with(validated)
        + """select source_id, count(*) as discovered, count_if(disposition = 'new') as fetched, count_if(disposition in ('known', 'language', 'duplicate')) as skipped,
  count_if(disposition = 'error') as errors, count_if(disposition = 'invalid') as validation_skipped,
  case when count_if(disposition = 'error') > 0 and count_if(disposition = 'new') = 0 then 'failed' when count_if(disposition = 'error') > 0 then 'partial' else 'success' end as status
from decided0 group by source_id""",
        "ingest_errors": _with(decided_all)
        + """, e as (select *, row_number() over (partition by source_id order by position) as n from decided0 where disposition = 'error')
select source_id, string_agg('broken ' || position, '; ' order by position) as error_summary from e where n <= 10 group by source_id""",
        "ingest_error_rows": _with(decided_all) + "select source_id, position, 'broken' as error from decided0 where disposition = 'error'",
        "ingest_runs": _with(decided)
        + """, e as (select source_id, min(position) as p from decided0 where disposition = 'error' group by source_id),
a as (select source_id, count(*) as n, count_if(disposition = 'new') as f, count_if(disposition in ('known', 'language', 'duplicate')) as k,
  count_if(disposition = 'error') as x, count_if(disposition = 'invalid') as i from decided0 group by source_id),
s as (select *, case key when 'it' then 'timeout' when 'de' then 'sitemap cut off' end as failure
  from (values (1, 'de'), (2, 'en'), (3, 'es'), (4, 'fr'), (5, 'it'), (6, 'pt')) as t(id, key)),
j as (select *, coalesce(x, 0) + (failure is not null)::int as errs from s left join a on a.source_id = s.id left join e on e.source_id = s.id)
select key as source, coalesce(n, 0) as discovered, coalesce(f, 0) as fetched, coalesce(k, 0) as skipped, errs as errors, coalesce(i, 0) as validation_skipped,
  coalesce(n, 0) as soft_deleted, case when errs > 0 and coalesce(f, 0) = 0 then 'failed' when errs > 0 then 'partial' else 'success' end as status,
  300.0::double as duration_seconds, coalesce('Discovery failed: ' || failure, case when p is not null then 'broken' end) as first_error from j""",
        "suspicious_records": """with l as (select doc_id, string_split(text, '.') as x from documents)
select doc_id as position, case when len(x) = 0 then null when list_sum(list_transform(x, lambda i: length(i))) / len(x) > 150 then 'long lines'
  when len(x) >= 3 and len(list_filter(x, lambda i: regexp_matches(i, '[0-9]'))) / len(x) < 0.2 then 'few quantities' end as reason from l""",
        "soft_deleted": _with(_RECIPES)
        + """, f as (select source_id, id from recipes where id % 10 > 0 and source_id < 4),
s as (select source_id, id, case when status = 'active' and source_id in (select source_id from f) and id not in (select id from f) then 'deleted' else status end as status from recipes)
select source_id, status, count(*) as n, sum(id) as ids from s group by all""",
        "interrupted_runs": """select event_id as id, event_type as source, case when event_type = 'click' and value > 10 then 'crashed' when value > 10 then 'running' else 'success' end as status,
  case when event_type = 'click' and value > 10 then round(date_diff('microsecond', ts, timestamp '2024-02-01') / 1e6, 2) end as duration_seconds from events""",
        "ingested_recipes": f"""with {_INGESTED}
select id, source_id, case when o % 9 = 0 then 'japanische-suppe-' else 'teller-' end || o || '-de' as source_external_id,
  {_FOLD.format(_TITLES + "[t + 1]")} as title_normalised, 4 as servings, minutes as prep_minutes, minutes as total_minutes, course, cuisine,
  case when o % 5 = 0 or minutes > 60 then 'advanced' when minutes > 30 then 'medium' when minutes > 0 then 'easy' end as difficulty,
  cooking_method, case when ware_id is not null then 'beef' end as primary_protein,
  case when course in ('starter', 'side') then 'light' else 'medium' end as weight_class,
  concat_ws('|', case when ware_id is not null then 'dairy-free' end, case when minutes <= 30 then 'quick' end) as dietary_flags,
  case when ware_id is not null then 'grain' else '' end as food_groups from x""",
        "ingested_lines": f"""with {_INGESTED}
select id as recipe_id, 1 as seq, null as ingredient_id, 2 as quantity, 'EL' as unit, '2 EL Sojasauce' as raw_text from x
union all select id, 2, null, [1, 200, null][second + 1], ['Stück', 'g', null][second + 1], ['1 Stück Ingwer', '200 g Linsen', 'Wasser'][second + 1] from x
union all select id, 3, ware_id, 200, 'g', case when ware % 3 = 0 then '200 g Sonderware ' else '200 g Ware ' end || ware from x""",
        "document_steps": """select doc_id as recipe_id, i as step_no, sha256(x[i]) as text, null as image_url
from (select doc_id, string_split(text, chr(10)) as x from documents), unnest(range(1, len(x) + 1)) t(i)""",
        "document_images": """select doc_id as recipe_id, i as seq, 'https://img.example.org/' || doc_id || '/' || (i - 1) as url, null as local_path, sha256(c[i]) as caption
from (select doc_id, string_split(text, chr(10)) as x, string_split(text, '.') as c from documents), unnest(range(1, len(x) + 1)) t(i)""",
        "french_names": f"""with c as {names},
n as (select case l_linenumber when 1 then 'une pincée de ' || p_name when 2 then 'un peu d' || chr(39) || upper(p_name[1]) || substr(split_part(p_name, ' ', 1), 2) || ' '
      || upper(split_part(p_name, ' ', 2)[1]) || substr(split_part(p_name, ' ', 2), 2)
    when 3 then 'quelques ' || p_name || 's' when 4 then '200 g ' || upper(p_name) when 5 then 'de la ' || p_name || ', coupé fin'
    when 6 then 'Bio-' || replace(p_name, ' ', '-') else 'sans ' || p_name end as ingredient, p_name, l_linenumber <= 6 as sold
  from lineitem join part on l_partkey = p_partkey)
select ingredient, count(*) as n, case when sold then replace(p_name, ' ', '-') end as key, case when sold then any_value(c.id) end as id
from n join c using (p_name) group by ingredient, sold, p_name""",
        "hyphen_names": f"""with c as {names},
n as (select distinct upper(p_type[1]) || lower(substr(p_type, 2)) || '-' || p_name || case when p_size % 2 = 0 then 'en' else '' end as name, p_name from part)
select name, replace(p_name, ' ', '-') as key, id from n join c using (p_name)""",
        "duration_texts": """with t as (select o_orderkey, cast(floor(o_totalprice % 7) as int) as h, day(o_orderdate) as m, left(o_orderpriority, 1) as p from orders)
select o_orderkey, case p when '1' then 'PT' || case when h > 0 then h || 'H' else '' end || m || 'M' when '2' then case when h > 0 then 'PT' || h || 'H' else '' end
  when '3' then 'PT' || m || 'M' else '' end as iso from t""",
        "recipe_addresses": """with s(source, pattern) as (values {rules}),
p as (select page_id, 'https://www.example.ch' || regexp_replace(regexp_extract(url, '^[a-z]+://[^/]*(/.*)$', 1), '^/(de|fr)/', '/\\1/rezepte/') as a from pages)
select page_id, source, regexp_matches(a, pattern) as is_recipe, case when contains(a, '/fr/') then 'fr' when source in ({italian}) and contains(a, '/it/') then 'it' else 'de' end as language
from p, s""".format(
            rules=", ".join(f"('{r.key}', '{r.url_pattern}')" for r in SM.enabled_sources(disabled=("schweizerfleisch",))),
            italian=", ".join(f"'{r.key}'" for r in SM.SOURCES if ("/it/", "it") in r.languages) or "''",
        ),
        "picture_addresses": """select page_id, url as first, 'https://img.example.ch' || regexp_extract(url, '^[a-z]+://[^/]*(/.*)$', 1) as whole, url as same from pages""",
        "props_records": """with l as (select doc_id, source, lang, string_split(text, chr(10)) as x from documents),
i as (select *, flatten(list_transform(x, lambda v: string_split(v, '.'))) as items from l)
select doc_id, source as title, '4 Portionen' as yield_amount, len(x) as n_groups, len(items) as n_items, lang as labels,
  sha256(array_to_string(list_transform(items, lambda v: '2dl' || regexp_replace(v, '\\s+', '', 'g')), '|')) as items from i""",
        "completed_records": """select doc_id, case when lang = 'en' then 'own' else 'Schnell|' || lang end as keywords, source as category, 'italian' as cuisine, '' as difficulty,
  lang || '|' || source as image_captions, len(string_split(text, chr(10))) as n_lines, case when trim(split_part(regexp_replace(text, '[<>&]', ' ', 'g'), chr(10), 1)) <> '' then 'Teig' else '' end as labels
from documents""",
        "stored_tables": """select "table", case "table" when 'recipes' then (select count(*) from orders) when 'recipe_steps' then 2 * (select count(*) from orders)
  when 'recipe_ingredients' then (select count(*) from lineitem) when 'sources' then 5 else 0 end as rows
from unnest({tables}) t("table")""".format(tables=sorted(SCHEMAS)),
        "folder_checks": """select 'recipe_steps_fk' as "check", count(*) as n from customer having count(*) > 0
union all select 'duplicate_recipes', count(*) from (select o_custkey from orders group by o_custkey having count(*) > 1) having count(*) > 0
union all select 'tables ok', 1 union all select 'schema_version ok', 1""",
        "page_titles": """select page_id, sha256(trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1),
  '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\\s+', ' ', 'g'))) as digest from pages""",
        "page_list_items": """with i as (select page_id, regexp_extract_all(html, '(?is)<li[^>]*>(.*?)</li>', 1) as x from pages),
c as (select page_id, list_transform(x, lambda v: trim(regexp_replace(replace(regexp_replace(v, '<[^>]*>', '', 'g'), '&amp;', '&'), '\\s+', ' ', 'g'))) as x from i)
select page_id, len(x) as n, array_to_string(x, '|') as items from c""",
        "page_records": """with i as (select page_id, url, html, list_transform(regexp_extract_all(html, '(?is)<li[^>]*>(.*?)</li>', 1),
  lambda v: trim(regexp_replace(replace(regexp_replace(v, '<[^>]*>', '', 'g'), '&amp;', '&'), '\\s+', ' ', 'g'))) as x from pages)
select page_id, case when contains(url, '/de/') then 'de' when contains(url, '/fr/') then 'fr' when contains(url, '/it/') then 'it' else 'de' end as language,
  len(list_filter(x, lambda v: regexp_matches(v, '(g |kg |dl |l |EL |TL |Stk|Prise)'))) as n_lines,
  0 as n_steps, 0 as n_keywords, '' as category, '' as cuisine, case when not contains(html, '<h1>') then 'no recipe title' end as error from i""",
        "markup_records": """with t as (select doc_id, lang, source, regexp_replace(text, '[<>&]', ' ', 'g') as text from documents),
l as (select *, list_filter(list_transform(string_split(text, chr(10)), lambda v: trim(regexp_replace(v, '\\s+', ' ', 'g'))), lambda v: v <> '') as x,
  list_distinct(list_filter([trim(regexp_replace(regexp_replace(i || ' ' || v, '\\s+', ' ', 'g'), '^[0-9]+ *', '')) for v, i in string_split(text, chr(10))], lambda v: v <> '')) as s from t)
select doc_id, 'Text & ' || lang as title, source as category, 'thai' as cuisine, 'Thai|' || lang as keywords,
  len(s) as n_steps, sha256(array_to_string(list_sort(s), '|')) as steps, len(x) as n_lines, sha256(array_to_string(x, '|')) as lines, case when len(x) > 0 then 'Teil' else '' end as labels from l""",
        "structured_records": """select doc_id, source as title, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) as n_lines,
  sha256(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), '|')) as lines,
  len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) as n_steps,
  sha256(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), '|')) as steps, cast(doc_id as varchar) as yield_amount, lang || '|' || source as keywords,
  'https://img.example.org/' || doc_id as image_urls, lang as image_captions from documents where doc_id % 7 <> 0""",
        "sitemap_addresses": """select page_id, 0 as position, url from pages union all select page_id, 1, 'b' from pages where page_id % 2 = 0""",
        "assigned_ids": "select o_orderkey, 999 + row_number() over (order by o_totalprice desc, o_orderkey) as new_id from orders",
        "line_ordinals": """select l_suppkey, l_orderkey, l_linenumber, l_partkey,
  row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey) as ordinal from lineitem""",
        "dossier_texts": _with(_RECIPES, _LINES, sections)
        + """select recipe_id, 0 as part, string_agg(case when seq = 0 and n > 1 then chr(10) || line else line end, chr(10) order by n) as text from dn group by recipe_id""",
        "dossier_sections": """with s as (select doc_id, string_split(text, chr(10)) as x from documents)
select doc_id, i - 1 as position, sha256(trim(x[i])) as section, 0 as body_length from s, unnest(range(2, len(x) + 1)) t(i)""",
        "windowed_tool_events": """select strftime(ts, '%Y-%m-%d') as day, event_type as tool, count(*) as calls, count_if(event_type = 'error') as errors,
  round(sum(value), 2) as total_ms, max(value) as max_ms from events group by all""",
        "streamed_ingest": """with r as (select list_position(['de', 'en', 'es', 'fr'], lang) as source_id, doc_id as position,
  sha256(lang || chr(31) || 'doc' || chr(31) || replace(text, '.', chr(10)) || chr(31) || text) as content_hash
  from documents where lang in ('de', 'en', 'fr') and doc_id % 41 <> 0)
select min(struct_pack(s := source_id, p := position)).s as source_id, min(struct_pack(s := source_id, p := position)).p as position, content_hash from r group by content_hash""",
    }
    return sql
