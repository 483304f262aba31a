"""SQL for another engine that gives the same result as each named query.

Written separately from the queries, as plain SQL over the given tables.
"""

from __future__ import annotations

from hearthline.functions.features import TOWN_REGION
from hearthline.functions.text import SPACES
from hearthline.operators.retrieval import CHUNK_OVERLAP, CHUNK_SIZE, SEPARATORS

SALES = """
sales AS (
  SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month,
    n_name AS town, r_name AS region, o_orderpriority AS flat_type, p_brand AS flat_model,
    l_extendedprice AS resale_price, l_extendedprice / l_quantity AS price_per_sqm,
    CASE WHEN l_orderkey % 97 = 0 THEN CAST(0 AS DOUBLE) ELSE l_quantity END AS floor_area_sqm,
    CAST(p_size AS DOUBLE) AS remaining_lease, CAST(l_linenumber AS DOUBLE) AS storey_mid,
    concat('STOREY ', l_linenumber) AS storey_range,
    CASE WHEN l_suppkey % 29 = 0 THEN NULL ELSE l_suppkey % 28 + 1 END AS district_number,
    CASE WHEN l_orderkey % 17 = 0 THEN NULL
      ELSE CAST(1.22 AS DOUBLE) + CAST(l_orderkey % 1000 AS DOUBLE) * CAST(0.00025 AS DOUBLE) END AS latitude,
    CASE WHEN l_orderkey % 17 = 0 THEN NULL
      ELSE CAST(103.6 AS DOUBLE) + CAST(l_partkey % 1000 AS DOUBLE) * CAST(0.0004 AS DOUBLE) END AS longitude,
    concat('MRT_', l_suppkey % 40) AS nearest_mrt_name,
    concat('SCHOOL_', l_partkey % 60) AS nearest_schools_name,
    CASE WHEN l_suppkey % 13 = 0 THEN NULL ELSE CAST(l_suppkey % 50 AS DOUBLE) / 10 END AS nearest_mrt_distance_km,
    CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE CAST(l_partkey % 40 AS DOUBLE) / 10 END AS nearest_schools_distance_km,
    CAST(l_suppkey % 20 AS DOUBLE) / 10 AS nearest_childcare_distance_km,
    CAST(l_orderkey % 25 AS DOUBLE) / 10 AS nearest_supermarkets_distance_km,
    CAST(l_partkey % 30 AS DOUBLE) / 10 AS nearest_hawker_distance_km
  FROM lineitem
  LEFT JOIN orders ON l_orderkey = o_orderkey
  LEFT JOIN customer ON o_custkey = c_custkey
  LEFT JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN part ON l_partkey = p_partkey
)"""

DISTANCES = [
    "nearest_mrt_distance_km",
    "nearest_schools_distance_km",
    "nearest_childcare_distance_km",
    "nearest_supermarkets_distance_km",
    "nearest_hawker_distance_km",
]


def settled(expression: str, digits: int = 6) -> str:
    return f"floor(({expression}) * 1e{digits} + 0.4137) / 1e{digits}"


def settle(digits: int, *names: str) -> str:
    return ", ".join(f"{settled(n, digits)} AS {n}" for n in names)


def label(c: str) -> str:
    return f"replace(replace(replace(upper(trim({c})), '-', ' '), '/', ' '), '  ', ' ')"


def titled(c: str) -> str:
    words = f"string_split(replace({c}, '_', ' '), ' ')"
    return f"array_to_string(list_transform({words}, lambda w: upper(w[1]) || lower(w[2:])), ' ')"


def quoted(c: str) -> str:
    plain = (
        f"replace(replace(replace(replace({c}, '\\', '\\\\'), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t')"
    )
    return (
        f"CASE WHEN contains({c}, '''') AND NOT contains({c}, '\"') THEN '\"' || {plain} || '\"' "
        f"ELSE '''' || replace({plain}, '''', '\\''') || '''' END"
    )


def shown_list(c: str) -> str:
    return f"'[' || array_to_string(list_transform({c}, lambda s: {quoted('s')}), ', ') || ']'"


def share(text: str, words: str) -> str:
    return (
        f"CASE WHEN len({words}) = 0 THEN 1.0 ELSE "
        f"CAST(len(list_filter({words}, lambda w: contains(lower({text}), lower(w)))) AS DOUBLE) / len({words}) END"
    )


def word_count(text: str) -> str:
    inside = "".join(f"\\x{{{ord(ch):x}}}" for ch in SPACES)
    return f"len(regexp_extract_all({text}, '[^{inside}]+'))"


def with_sales(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([SALES.strip(), *[c.strip() for c in ctes]]) + "\n" + body


SEGMENTS = f"""
segments AS (
  SELECT * REPLACE ({label('flat_type')} AS flat_type) FROM sales WHERE town IS NOT NULL AND flat_type IS NOT NULL
)"""

BOUNDS = """
grid AS (
  SELECT town, flat_type FROM (SELECT DISTINCT town FROM sales WHERE town IS NOT NULL)
  CROSS JOIN (SELECT DISTINCT flat_type FROM segments)
),
own AS (
  SELECT town, flat_type, quantile_cont(floor_area_sqm, 0.05) AS q05, quantile_cont(floor_area_sqm, 0.95) AS q95,
    median(floor_area_sqm) AS q50
  FROM segments GROUP BY town, flat_type
),
market AS (
  SELECT quantile_cont(floor_area_sqm, 0.05) AS m05, quantile_cont(floor_area_sqm, 0.95) AS m95 FROM sales
),
edges AS (
  SELECT town, flat_type, floor(coalesce(q05, m05, 20.0)) AS low, ceil(coalesce(q95, m95, 200.0)) AS high0,
    coalesce(q50, 80.0) AS size
  FROM grid LEFT JOIN own USING (town, flat_type) CROSS JOIN market
),
bounds AS (
  SELECT town, flat_type, low, CASE WHEN high0 <= low THEN low + 1 ELSE high0 END AS high, size FROM edges
),
sizes AS (SELECT town, flat_type, low, high, least(greatest(size, low), high) AS default_size FROM bounds)"""

REQUESTS = """
requests AS (
  SELECT town, flat_type, default_size AS floor_area_sqm, coalesce(floor(lease), 60.0) AS remaining_lease
  FROM sizes LEFT JOIN (SELECT town, flat_type, median(remaining_lease) AS lease FROM segments GROUP BY ALL)
  USING (town, flat_type)
)"""

RATES = """
rates AS (
  SELECT town, flat_type, month, median(rate) AS price_per_sqm
  FROM (SELECT town, flat_type, month, resale_price / nullif(floor_area_sqm, 0) AS rate FROM segments)
  WHERE rate IS NOT NULL AND month IS NOT NULL GROUP BY ALL
)"""

HISTORY = """
history AS (
  SELECT town, flat_type, month, price_per_sqm, price_per_sqm * floor_area_sqm AS price,
    'Historical (area-adjusted)' AS type
  FROM rates JOIN requests USING (town, flat_type)
),
recent AS (
  SELECT town, flat_type, month, price FROM (
    SELECT *, max(month) OVER (PARTITION BY town, flat_type) AS last_month FROM history)
  WHERE month >= CAST(last_month - INTERVAL 24 MONTH AS DATE)
)"""

FORECAST = """
timed AS (
  SELECT town, flat_type, month, price_per_sqm AS y, month(month) AS cal,
    CAST(year(month) * 12 + month(month)
      - min(year(month) * 12 + month(month)) OVER (PARTITION BY town, flat_type) AS DOUBLE) AS t
  FROM rates
),
line AS (
  SELECT town, flat_type, count(*) AS points, regr_slope(y, t) AS b, regr_intercept(y, t) AS a, max(t) AS last_t,
    max(month) AS last_month, arg_max(y, month) AS last_rate
  FROM timed GROUP BY town, flat_type
),
season AS (
  SELECT town, flat_type, cal, avg(y - a - b * t) AS s FROM timed JOIN line USING (town, flat_type) GROUP BY ALL
),
spread AS (
  SELECT town, flat_type, coalesce(stddev_samp(y - a - b * t - s), 0.0) AS sigma
  FROM timed JOIN line USING (town, flat_type) JOIN season USING (town, flat_type, cal) GROUP BY ALL
),
asked AS (
  SELECT r.town, r.flat_type, r.floor_area_sqm AS area, points, a, b, last_t, last_month, last_rate, sigma,
    CASE WHEN coalesce(points, 0) < 24 THEN 'too little history' ELSE 'ok' END AS status
  FROM requests r LEFT JOIN line USING (town, flat_type) LEFT JOIN spread USING (town, flat_type)
),
ahead AS (
  SELECT asked.*, h.step, a + b * (last_t + h.step) + coalesce(s.s, 0.0) AS m
  FROM asked LEFT JOIN (SELECT unnest(range(1, 13)) AS step) h ON status = 'ok'
  LEFT JOIN season s ON s.town = asked.town AND s.flat_type = asked.flat_type
    AND s.cal = (month(last_month) - 1 + h.step) % 12 + 1
),
levelled AS (
  SELECT *, max(CASE WHEN step = 1 THEN m END) OVER (PARTITION BY town, flat_type) AS m1 FROM ahead
),
scaled AS (
  SELECT *, CASE WHEN m1 > 0 AND last_rate / m1 > 0 AND isfinite(last_rate / m1) THEN last_rate / m1 ELSE 1.0 END
    * area AS k FROM levelled
),
forecast AS (
  SELECT town, flat_type, status, CAST(coalesce(points, 0) AS BIGINT) AS points, CAST(step AS BIGINT) AS step,
    CAST(date_trunc('month', last_month) + to_months(CAST(step AS INTEGER)) AS DATE) AS month,
    CASE WHEN step IS NOT NULL THEN greatest(m * k, 0.0) END AS predicted_mean,
    CASE WHEN step IS NOT NULL THEN greatest((m - 1.959963984540054 * sigma) * k, 0.0) END AS mean_ci_lower,
    CASE WHEN step IS NOT NULL THEN greatest((m + 1.959963984540054 * sigma) * k, 0.0) END AS mean_ci_upper
  FROM scaled
)"""

REQUEST_PARTS = [SEGMENTS, BOUNDS, REQUESTS]
FORECAST_PARTS = [*REQUEST_PARTS, RATES, HISTORY, FORECAST]

MESSAGES = """
messages AS (
  SELECT conv_id, turn, text,
    CASE WHEN role = 'user' THEN 'human' WHEN role = 'assistant' AND conv_id % 2 = 1 THEN 'tool'
      WHEN role = 'assistant' THEN 'ai' ELSE role END AS role,
    role = 'assistant' AND conv_id % 2 = 0 AND turn % 4 = 1 AS calls
  FROM conversations
)"""

CASES = """
cases AS (
  SELECT doc_id AS ord, 'q' || doc_id AS question, text AS response,
    CASE lang WHEN 'en' THEN 'price_prediction' WHEN 'fr' THEN 'area_info' WHEN 'de' THEN 'price_info'
      WHEN 'es' THEN 'comparison' END AS category,
    CASE WHEN n_chars < 500 THEN 'easy' WHEN n_chars < 2000 THEN 'medium' ELSE 'hard' END AS difficulty,
    CASE lang WHEN 'en' THEN ['The', 'dashboard', 'tion', 'is'] WHEN 'fr' THEN ['que', 'EAU', 'le']
      WHEN 'de' THEN ['und', 'ich'] ELSE [] END AS keywords,
    CASE lang WHEN 'en' THEN ['on', 'Marina'] WHEN 'de' THEN ['Ver'] WHEN 'es' THEN ['la', 'los', 'Que']
      ELSE [] END AS areas
  FROM documents
)"""

MENTIONS = f"""
mentions AS (
  SELECT *, {share('response', 'keywords')} AS keyword_score, {share('response', 'areas')} AS area_score FROM cases
)"""

QUALITY = f"""
spoken AS (SELECT 'q' || conv_id AS question, arg_max(text, turn) AS said FROM conversations GROUP BY ALL),
replied AS (
  SELECT c.* REPLACE (coalesce(said, '') AS response) FROM cases c LEFT JOIN spoken USING (question)
),
counted AS (
  SELECT *, {share('response', 'keywords')} AS keyword_score, {share('response', 'areas')} AS area_score,
    {word_count('response')} AS words FROM replied
),
measured AS (
  SELECT *, CASE WHEN words BETWEEN 10 AND 100 THEN 1.0 WHEN words BETWEEN 5 AND 9 OR words BETWEEN 101 AND 150 THEN 0.7
    WHEN words < 5 THEN 0.3 ELSE 0.5 END::DOUBLE AS length_score FROM counted
),
quality AS (
  SELECT *, keyword_score * 0.5::DOUBLE + area_score * 0.3::DOUBLE + length_score * 0.2::DOUBLE AS quality_score
  FROM measured
)"""

TOPICS = """
topics AS (
  SELECT label, list(x ORDER BY i) AS centre FROM (
    SELECT label, i, avg(CAST(x AS DOUBLE)) AS x FROM (
      SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)
    GROUP BY label, i)
  GROUP BY label
)"""

COSINE = """list_dot_product({a}::DOUBLE[], {b}::DOUBLE[])
  / (sqrt(list_dot_product({a}::DOUBLE[], {a}::DOUBLE[])) * sqrt(list_dot_product({b}::DOUBLE[], {b}::DOUBLE[])))"""

ACCURACY = f"""
likeness AS (
  SELECT vec_id AS ord, {COSINE.format(a='embedding', b='centre')} AS similarity
  FROM embeddings JOIN topics USING (label)
),
accuracy AS (
  SELECT *, similarity * 0.6::DOUBLE + keyword_score * 0.25::DOUBLE + area_score * 0.15::DOUBLE AS accuracy_score
  FROM mentions LEFT JOIN likeness USING (ord)
)"""

HANDLED = f"""
phrases AS (
  SELECT *, {share('response', "['dashboard', 'prediction', 'analytics', 'machine learning', 'forecasting']")}
      AS redirect_score,
    1.0::DOUBLE - {share('response', "['will be', 'predicted price', 'future price is', 'estimate is']")} AS avoid_score
  FROM cases WHERE category = 'price_prediction'
),
handled AS (SELECT *, redirect_score * 0.7::DOUBLE + avoid_score * 0.3::DOUBLE AS handling_score FROM phrases)"""

OVERALL = """
metrics AS (
  SELECT 'ground_truth_accuracy' AS metric, coalesce(avg(accuracy_score), 0.0) AS score FROM accuracy
  UNION ALL SELECT 'response_quality', coalesce(avg(quality_score), 0.0) FROM quality
  UNION ALL SELECT 'price_prediction_handling', coalesce(avg(handling_score), 0.0) FROM handled
  UNION ALL SELECT 'response_time', CASE WHEN coalesce(avg(value), 0) <= 2 THEN 1.0 WHEN avg(value) <= 5 THEN 0.8
    WHEN avg(value) <= 10 THEN 0.6 ELSE 0.4 END::DOUBLE FROM events
),
overall AS (SELECT * FROM metrics UNION ALL SELECT 'overall', avg(score) FROM metrics)"""

TOP2 = f"""
compared AS (
  SELECT label, vec_id, {COSINE.format(a='embedding', b='centre')} AS similarity
  FROM topics CROSS JOIN (SELECT vec_id, embedding FROM embeddings)
),
top2 AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY similarity DESC, vec_id) AS rank FROM compared)
  WHERE rank <= 2
)"""


def trend_sets(measure: str) -> str:
    parts = []
    for dimension, category in (
        ("all", "NULL"),
        ("region", "region"),
        ("flat_type", "flat_type"),
        ("flat_model", "flat_model"),
    ):
        parts.append(
            f"SELECT month, '{dimension}' AS dimension, CAST({category} AS VARCHAR) AS category, {measure} AS v "
            "FROM sales WHERE month IS NOT NULL"
        )
    union = "\nUNION ALL ".join(parts)
    return with_sales(
        f"""SELECT month, dimension, category, count(v) AS n, {settled('avg(v)')} AS mean, {settled('min(v)')} AS min,
  {settled('max(v)')} AS max, {settled('median(v)')} AS median
FROM ({union}) GROUP BY month, dimension, category"""
    )


def ranking(measure: str) -> str:
    dimensions = ["flat_type", "region", "town", "flat_model", "district_number"]
    union = "\nUNION ALL ".join(
        f"SELECT '{d}' AS dimension, CAST({d} AS VARCHAR) AS category, {measure} AS v FROM sales WHERE {d} IS NOT NULL"
        for d in dimensions
    )
    return with_sales(
        f"""SELECT dimension, category, n, {settle(6, 'mean', 'median')},
  row_number() OVER (PARTITION BY dimension ORDER BY mean DESC, category) AS mean_rank,
  row_number() OVER (PARTITION BY dimension ORDER BY median DESC, category) AS median_rank,
  count(*) OVER (PARTITION BY dimension) AS categories, {titled('dimension')} AS title
FROM (SELECT dimension, category, count(v) AS n, avg(v) AS mean, median(v) AS median FROM ({union}) GROUP BY ALL)"""
    )


def line_columns(x: str, y: str) -> str:
    slope, intercept = f"regr_slope({y}, {x})", f"regr_intercept({y}, {x})"
    return f"""CAST(regr_count({y}, {x}) AS BIGINT) AS n, {settled(slope, 4)} AS slope, {settled(intercept, 4)} AS intercept,
  {settled(f'regr_r2({y}, {x})', 8)} AS r2, {settled(f'min({x})', 4)} AS x_min, {settled(f'max({x})', 4)} AS x_max,
  {settled(f'{intercept} + {slope} * min({x})', 4)} AS y_at_min,
  {settled(f'{intercept} + {slope} * max({x})', 4)} AS y_at_max"""


def regression(x: str, y: str) -> str:
    parts = [f"SELECT 'all' AS dimension, CAST(NULL AS VARCHAR) AS category, {x} AS x, {y} AS y FROM sales"]
    for d in ("region", "flat_type", "town"):
        parts.append(f"SELECT '{d}', {d}, {x}, {y} FROM sales WHERE {d} IS NOT NULL")
    union = "\nUNION ALL ".join(parts)
    return with_sales(
        f"SELECT dimension, category, {line_columns('x', 'y')} FROM ({union}) "
        "WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY dimension, category"
    )


def regression_grid() -> str:
    parts = []
    for v in EXPLANATORY:
        for m in ("resale_price", "price_per_sqm"):
            for d in ("all", "region", "flat_type", "town"):
                shown = "CAST(NULL AS VARCHAR)" if d == "all" else d
                wanted = "" if d == "all" else f" AND {d} IS NOT NULL"
                parts.append(
                    f"SELECT '{v}' AS variable, '{m}' AS measure, '{d}' AS dimension, {shown} AS category, {v} AS x, {m} AS y "
                    f"FROM sales WHERE {v} IS NOT NULL AND {m} IS NOT NULL{wanted}"
                )
    union = "\nUNION ALL ".join(parts)
    return with_sales(f"SELECT variable, measure, dimension, category, {line_columns('x', 'y')} FROM ({union}) GROUP BY ALL")


EXPLANATORY = [
    "floor_area_sqm",
    "remaining_lease",
    "storey_mid",
    "nearest_mrt_distance_km",
    "nearest_hawker_distance_km",
    "nearest_supermarkets_distance_km",
]


def regression_all(y: str) -> str:
    union = "\nUNION ALL ".join(f"SELECT '{v}' AS variable, {v} AS x, {y} AS y FROM sales" for v in EXPLANATORY)
    return with_sales(
        f"SELECT variable, {line_columns('x', 'y')} FROM ({union}) "
        "WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY variable"
    )


KPI = with_sales(
    f"""SELECT month, strftime(month, '%B %Y') AS month_name, {settle(6, 'median_price', 'prev_median_price')},
  {settled('CASE WHEN prev_median_price > 0 THEN (median_price - prev_median_price) / prev_median_price * 100 ELSE 0.0 END')}
    AS median_price_change_pct,
  transactions, prev_transactions,
  {settled('CASE WHEN prev_transactions > 0 THEN (transactions::DOUBLE - prev_transactions) / prev_transactions * 100 ELSE 0.0 END')}
    AS transactions_change_pct,
  {settled('median_price / nullif(base, 0) * 100')} AS price_index,
  {settled('median_price / nullif(base, 0) * 100 - 100')} AS index_vs_base_pct,
  top_region, {settle(6, 'top_region_median')}, top_flat_type, top_flat_type_share_pct
FROM latest
CROSS JOIN (SELECT median(resale_price) AS median_price, count(*) AS transactions FROM sales, latest
  WHERE sales.month = latest.month)
CROSS JOIN (SELECT median(resale_price) AS prev_median_price, nullif(count(*), 0) AS prev_transactions FROM sales, latest
  WHERE sales.month = CAST(latest.month - INTERVAL 1 MONTH AS DATE))
CROSS JOIN (SELECT median(resale_price) AS base FROM sales WHERE year(month) = 1997)
CROSS JOIN (SELECT region AS top_region, median(resale_price) AS top_region_median FROM sales, latest
  WHERE sales.month = latest.month AND region IS NOT NULL GROUP BY region ORDER BY 2 DESC, 1 LIMIT 1)
CROSS JOIN (SELECT flat_type AS top_flat_type,
    round_even(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 1) AS top_flat_type_share_pct
  FROM sales, latest WHERE sales.month = latest.month AND flat_type IS NOT NULL
  GROUP BY flat_type ORDER BY count(*) DESC, 1 LIMIT 1)""",
    "latest AS (SELECT max(month) AS month FROM sales)",
)


def half_away(c: str) -> str:
    """Two decimals, halves away from zero on the decimal digits."""
    return f"CAST(round(CAST(CAST({c} AS VARCHAR) AS DECIMAL(38, 18)), 2) AS DOUBLE)"


MAP = with_sales(
    f"""SELECT latitude, longitude, {settled('resale_price')} AS resale_price, price_per_sqm, flat_type, flat_model,
  floor_area_sqm, storey_range, region, strftime(month, '%b %Y') AS month, district_number, nearest_mrt_name,
  nearest_mrt_distance_km, nearest_schools_name, nearest_schools_distance_km,
  {settled('''(resale_price - min(resale_price) OVER ())
    / coalesce(nullif(max(resale_price) OVER () - min(resale_price) OVER (), 0), 1)''')} AS price_norm
FROM extract""",
    f"""shown AS (
  SELECT latitude, longitude, resale_price / 1000.0::DOUBLE AS resale_price, {half_away('price_per_sqm')} AS price_per_sqm,
    flat_type, flat_model, floor_area_sqm, storey_range, region, month, district_number, nearest_mrt_name,
    {half_away('nearest_mrt_distance_km')} AS nearest_mrt_distance_km, nearest_schools_name,
    {half_away('nearest_schools_distance_km')} AS nearest_schools_distance_km
  FROM sales WHERE latitude IS NOT NULL AND longitude IS NOT NULL AND month IS NOT NULL
)""",
    """extract AS (
  SELECT * FROM shown ORDER BY month DESC,
    md5(concat_ws('|', CAST(CAST(round(resale_price * 1e5) AS BIGINT) AS VARCHAR),
      CAST(CAST(round(latitude * 1e6) AS BIGINT) AS VARCHAR), CAST(CAST(round(longitude * 1e6) AS BIGINT) AS VARCHAR),
      CAST(CAST(round(floor_area_sqm * 100) AS BIGINT) AS VARCHAR), flat_type, flat_model, region,
      CAST(district_number AS VARCHAR), nearest_mrt_name, nearest_schools_name)),
    latitude NULLS LAST, longitude NULLS LAST, resale_price NULLS LAST, price_per_sqm NULLS LAST, flat_type NULLS LAST,
    flat_model NULLS LAST, floor_area_sqm NULLS LAST, storey_range NULLS LAST, region NULLS LAST,
    district_number NULLS LAST, nearest_mrt_name NULLS LAST, nearest_mrt_distance_km NULLS LAST,
    nearest_schools_name NULLS LAST, nearest_schools_distance_km NULLS LAST
  LIMIT 20000
)""",
)

TOWN_MAP = with_sales(
    f"""SELECT town, place, strftime(month, '%b %Y') AS month_text, round_even(resale_price / 1000, 0) AS resale_price_k,
  round_even(price_per_sqm, 0) AS price_per_sqm, flat_type, round_even(floor_area_sqm, 0) AS floor_area_sqm,
  CAST(round_even(remaining_lease, 0) AS VARCHAR) || ' yrs' AS lease_text, {settle(6, 'latitude', 'longitude')},
  {', '.join(f'round_even({d}, 2) AS {d}' for d in DISTANCES)},
  {settled('avg(latitude) OVER (PARTITION BY town)')} AS centre_latitude,
  {settled('avg(longitude) OVER (PARTITION BY town)')} AS centre_longitude
FROM (SELECT *, row_number() OVER (PARTITION BY town ORDER BY month DESC, resale_price NULLS LAST,
    price_per_sqm NULLS LAST, flat_type NULLS LAST, floor_area_sqm NULLS LAST, remaining_lease NULLS LAST,
    latitude NULLS LAST, longitude NULLS LAST, {', '.join(f'{d} NULLS LAST' for d in DISTANCES)}) AS place
  FROM sales WHERE town IS NOT NULL AND latitude IS NOT NULL AND longitude IS NOT NULL)
WHERE place <= 1000"""
)

HISTOGRAM = with_sales(
    f"""SELECT town, CAST(bin AS BIGINT) AS bin, {settled('start + bin * step')} AS bin_start,
  {settled('start + (bin + 1) * step')} AS bin_end, count(*) AS n, max(total) AS total
FROM (SELECT town, start, step, total,
    floor((least(resale_price, greatest(ceil(hi / step) * step - step, start)) - start) / step + 1e-14) AS bin
  FROM sales JOIN edges USING (town) WHERE resale_price IS NOT NULL)
GROUP BY town, bin, start, step""",
    """spans AS (
  SELECT town, min(resale_price) AS lo, max(resale_price) AS hi, count(resale_price) AS total,
    coalesce(nullif(max(resale_price) - min(resale_price), 0), nullif(abs(min(resale_price)), 0), 1) AS span
  FROM sales WHERE town IS NOT NULL GROUP BY town
)""",
    "s1 AS (SELECT *, pow(10.0, round(log10(span)) - 2) AS p FROM spans)",
    "s2 AS (SELECT *, CASE WHEN ceil(span / p) > 35 THEN p * 10 ELSE p END AS q FROM s1)",
    "s3 AS (SELECT *, CASE WHEN span / (q / 5) <= 35 THEN q / 5 ELSE q END AS r FROM s2)",
    "s4 AS (SELECT *, CASE WHEN span / (r / 2) <= 35 THEN r / 2 ELSE r END AS step FROM s3)",
    """s5 AS (
  SELECT *, floor(lo / step + pow(10.0, -(CASE WHEN step >= 1 THEN 0 ELSE floor(-log10(step)) + 1 END) - 1)) * step AS v
  FROM s4
)""",
    "edges AS (SELECT town, hi, total, step, CASE WHEN lo < v THEN v - step ELSE v END AS start FROM s5)",
)

REGION_FEATURE = {
    "AFRICA": "region_Africa",
    "AMERICA": "region_America",
    "ASIA": "region_Asia",
    "EUROPE": "region_Europe",
    "MIDDLE EAST": "region_Middle_East",
}
FLAT_FEATURE = {
    "1 URGENT": "flat_type_1_URGENT",
    "2 HIGH": "flat_type_2_HIGH",
    "3 MEDIUM": "flat_type_3_MEDIUM",
    "4 NOT SPECIFIED": "flat_type_4_NOT_SPECIFIED",
    "5 LOW": "flat_type_5_LOW",
}


def hot(c: str, value: str, name: str) -> str:
    return f"CASE WHEN {c} = '{value}' THEN 1.0 ELSE 0.0 END::DOUBLE AS \"{name}\""


ONEHOT = with_sales(
    "SELECT month, town, flat_type, region, resale_price, year(month) AS year, "
    + ", ".join(hot(label("flat_type"), v, n) for v, n in FLAT_FEATURE.items())
    + ", "
    + ", ".join(hot("region", v, n) for v, n in REGION_FEATURE.items())
    + ", CAST(NULL AS VARCHAR) AS mapped_region FROM sales"
)

TOWNS = ", ".join(f"'{t}'" for t in sorted(TOWN_REGION))
TOWN_FEATURES = with_sales(
    "SELECT month, listed_town, flat_type, resale_price, year(month) AS year, "
    + ", ".join(hot(label("flat_type"), v, n) for v, n in FLAT_FEATURE.items())
    + ", "
    + ", ".join(hot("mapped_region", n, n) for n in sorted(set(TOWN_REGION.values())))
    + ", mapped_region FROM sales LEFT JOIN listed USING (town)",
    f"""listed AS (
  SELECT n_name AS town, listed_town, CASE {" ".join(f"WHEN listed_town = '{t}' THEN '{r}'" for t, r in TOWN_REGION.items())} END AS mapped_region
  FROM (SELECT n_name, [{TOWNS}][n_nationkey + 1] AS listed_town FROM nation)
)""",
)

ALIGN = with_sales(
    "SELECT town, flat_type, floor_area_sqm, remaining_lease, 1.0::DOUBLE AS nearest_mrt_distance_km, "
    + hot("flat_type", "1 URGENT", "flat_type_1 URGENT")
    + ", "
    + hot("flat_type", "4 NOT SPECIFIED", "flat_type_4 NOT SPECIFIED")
    + ', 0.0::DOUBLE AS "flat_type_9 UNKNOWN", '
    + hot("r_name", "ASIA", "region_Asia")
    + ", "
    + hot("r_name", "MIDDLE EAST", "region_Middle East")
    + " FROM requests LEFT JOIN nation ON n_name = town LEFT JOIN region ON r_regionkey = n_regionkey",
    *REQUEST_PARTS,
)

NEAR = f"""
near AS (
  SELECT s.town, s.flat_type, r.floor_area_sqm AS request_area, r.remaining_lease AS request_lease, s.month,
    s.floor_area_sqm, s.remaining_lease, {', '.join('s.' + d for d in DISTANCES)}, s.resale_price,
    row_number() OVER (PARTITION BY s.town, s.flat_type ORDER BY s.month DESC NULLS LAST, s.floor_area_sqm NULLS LAST,
      s.remaining_lease NULLS LAST, {', '.join(f's.{d} NULLS LAST' for d in DISTANCES)}, s.resale_price NULLS LAST) AS rank
  FROM segments s JOIN requests r ON s.town = r.town AND s.flat_type = r.flat_type
    AND s.floor_area_sqm BETWEEN r.floor_area_sqm * 0.85::DOUBLE AND r.floor_area_sqm * 1.15::DOUBLE
    AND s.remaining_lease BETWEEN greatest(0, r.remaining_lease - 10) AND least(99, r.remaining_lease + 10)
)"""

NEAR_ON_MAP = (
    NEAR.replace("near AS", "near_on_map AS")
    .replace("s.resale_price,\n", "s.resale_price, s.price_per_sqm, s.latitude, s.longitude,\n")
    .replace("s.resale_price NULLS LAST)", "s.resale_price NULLS LAST, s.price_per_sqm NULLS LAST, s.latitude, s.longitude)")
    .replace("least(99, r.remaining_lease + 10)", "least(99, r.remaining_lease + 10) AND s.latitude IS NOT NULL AND s.longitude IS NOT NULL")
)

COMPARABLES_MAP = with_sales(
    f"""SELECT town, request_area, request_lease, rank, strftime(month, '%b %Y') AS month_text,
  round_even(resale_price / 1000, 0) AS resale_price_k, round_even(price_per_sqm, 0) AS price_per_sqm, flat_type,
  round_even(floor_area_sqm, 0) AS floor_area_sqm, CAST(round_even(remaining_lease, 0) AS VARCHAR) || ' yrs' AS lease_text,
  {settle(6, 'latitude', 'longitude')}, {', '.join(f'round_even({d}, 2) AS {d}' for d in DISTANCES)}
FROM near_on_map WHERE rank <= 1000""",
    *REQUEST_PARTS,
    NEAR_ON_MAP,
)

EXOG = with_sales(
    """SELECT town, flat_type, CASE WHEN matched IS NULL THEN 'no matching flat type' ELSE 'ok' END AS status,
  matched AS matched_column, CAST(step AS BIGINT) AS step,
  CAST(date_trunc('month', last_month) + to_months(CAST(step AS INTEGER)) AS DATE) AS month,
  coalesce(district, 0.0) AS district_number, """
    + ", ".join(
        hot("matched", n, n)
        for n in ("flat_type_1_URGENT", "flat_type_2 HIGH", "flat_type_3-MEDIUM", "flat_type_4_NOT_SPECIFIED")
    )
    + """
FROM (SELECT *, CASE flat_type WHEN '1 URGENT' THEN 'flat_type_1_URGENT' WHEN '2 HIGH' THEN 'flat_type_2 HIGH'
    WHEN '3 MEDIUM' THEN 'flat_type_3-MEDIUM' WHEN '4 NOT SPECIFIED' THEN 'flat_type_4_NOT_SPECIFIED' END AS matched
  FROM requests) JOIN (SELECT town, flat_type, max(month) AS last_month FROM rates GROUP BY ALL) USING (town, flat_type)
LEFT JOIN modes USING (town, flat_type) LEFT JOIN (SELECT unnest(range(1, 13)) AS step) ON matched IS NOT NULL""",
    *REQUEST_PARTS,
    RATES,
    """modes AS (
  SELECT town, flat_type, CAST(district_number AS DOUBLE) AS district FROM (
    SELECT town, flat_type, district_number,
      row_number() OVER (PARTITION BY town, flat_type ORDER BY count(*) DESC, district_number) AS r
    FROM segments WHERE district_number IS NOT NULL GROUP BY town, flat_type, district_number) WHERE r = 1
)""",
)

SERIES = with_sales(
    f"""SELECT town, flat_type, month, {settled('price', 2)} AS price, type, {settle(2, 'ci_lower', 'ci_upper')},
  {settled('greatest(0.0, lo - pad)', 2)} AS y_low, {settled('hi + pad', 2)} AS y_high
FROM (SELECT *, 0.06::DOUBLE * CASE WHEN hi > lo THEN hi - lo ELSE greatest(1.0, hi) END AS pad FROM ranged)""",
    *FORECAST_PARTS,
    "ok AS (SELECT * FROM forecast WHERE status = 'ok')",
    "past AS (SELECT * FROM recent WHERE (town, flat_type) IN (SELECT (town, flat_type) FROM ok))",
    """series AS (
  SELECT town, flat_type, month, price, 'Historical' AS type, CAST(NULL AS DOUBLE) AS ci_lower,
    CAST(NULL AS DOUBLE) AS ci_upper FROM past
  UNION ALL SELECT town, flat_type, CAST(max(month) + INTERVAL 1 DAY AS DATE), NULL, 'Gap', NULL, NULL
    FROM past GROUP BY town, flat_type
  UNION ALL SELECT town, flat_type, month, predicted_mean, 'Forecast', mean_ci_lower, mean_ci_upper FROM ok
)""",
    """ranged AS (
  SELECT *, min(price) OVER (PARTITION BY town, flat_type) AS lo, max(price) OVER (PARTITION BY town, flat_type) AS hi
  FROM series
)""",
)

HEADLINE = with_sales(
    f"""SELECT town, flat_type, months, {settle(2, 'last_price', 'forecast_price', 'change_pct')},
  'SGD ' || format('{{:,.0f}}', forecast_price) AS forecast_text, format('{{:+.1f}}%', change_pct) AS change_text
FROM (SELECT *, (forecast_price - last_price) / nullif(last_price, 0) * 100 AS change_pct FROM
  (SELECT town, flat_type, arg_max(predicted_mean, month) AS forecast_price, max(step) AS months
   FROM forecast WHERE status = 'ok' GROUP BY ALL)
  JOIN (SELECT town, flat_type, arg_max(price, month) AS last_price FROM history GROUP BY ALL) USING (town, flat_type))""",
    *FORECAST_PARTS,
)

JUDGED = [
    """shown_as AS (
  SELECT town, flat_type, month, CASE WHEN month(month) <> 1 THEN predicted_mean END AS mean,
    CASE month(month) WHEN 2 THEN mean_ci_upper + 1.0::DOUBLE WHEN 3 THEN -1.0::DOUBLE ELSE mean_ci_lower END AS lower,
    CASE WHEN month(month) <> 4 THEN mean_ci_upper END AS upper
  FROM forecast WHERE status = 'ok'
)""",
    """judged AS (
  SELECT *, CASE WHEN mean IS NULL THEN 'no mean' WHEN lower IS NULL OR upper IS NULL THEN 'no band' WHEN lower < 0 THEN 'negative'
    WHEN NOT mean BETWEEN lower AND upper THEN 'mean outside its band' END AS reason FROM shown_as
)""",
]

PROFILE = f"""
profiles AS (
  SELECT doc_id, 'Area ' || doc_id AS area, 'SGD ' || n_chars || 'K' AS hdb_price_range,
    string_split(text, chr(10)) AS pros, [lang, source] AS cons,
    CASE WHEN lang <> 'es' THEN [source] END AS nearby_amenities, lang = 'en' AS has_hdb, source
  FROM documents
),
shown AS (
  SELECT *, {shown_list('pros')} AS pros_text, {shown_list('cons')} AS cons_text,
    {shown_list("coalesce(nearby_amenities, [])")} AS amenities_text FROM profiles
)"""

CONTENT = """concat_ws(chr(10), 'Area: ' || area, 'HDB Price range: ' || hdb_price_range, 'Pros: ' || pros_text,
  'Cons: ' || cons_text, 'Nearby Amenities: ' || amenities_text)"""

# Characters that are white space, for trimming both ends of a chunk.
WHITE = " || ".join(f"chr({c})" for c in range(0x3001) if chr(c).isspace())


def cut_level(pieces: str, mark: str, size: int, last: bool) -> str:
    """Pieces {t, o}: open ones that hold the mark are cut there; a null t is a border."""
    border = "{'t': CAST(NULL AS VARCHAR), 'o': false}"
    if mark:
        sign = " || ".join(f"chr({ord(c)})" for c in mark)
        holds = f"x.o AND contains(x.t, {sign})"
        parts = f"list_transform(string_split(x.t, {sign}), lambda y, i: CASE WHEN i > 1 THEN {sign} || y ELSE y END)"
    else:
        holds = "x.o"
        parts = "list_transform(range(1, CAST(length(x.t) + 1 AS BIGINT)), lambda i: substr(x.t, i, 1))"
    still_open = "false" if last else "true"
    placed = f"""CASE WHEN y = '' THEN [] WHEN length(y) < {size} THEN [{{'t': y, 'o': false}}]
    ELSE [{border}, {{'t': y, 'o': {still_open}}}, {border}] END"""
    return f"flatten(list_transform({pieces}, lambda x: CASE WHEN {holds} THEN flatten(list_transform({parts}, lambda y: {placed})) ELSE [x] END))"


def packed(pieces: str, size: int, overlap: int) -> str:
    """Chunks from pieces by a fold over {h: what is held, n: its length, out: chunks so far, b: a border}."""
    chunk = f"trim(array_to_string(s.h, ''), {WHITE})"
    out = f"CASE WHEN {chunk} = '' THEN s.out ELSE list_append(s.out, {chunk}) END"
    total = lambda held: f"coalesce(CAST(list_sum(list_transform({held}, lambda z: length(z))) AS BIGINT), 0)"
    last = "s.h[CAST(len(s.h) - k + 1 AS BIGINT) : len(s.h)]"
    keep = f"list_max(list_filter(range(0, CAST(len(s.h) + 1 AS BIGINT)), lambda k: {total(last)} <= least({overlap}, {size} - x.n)))"
    tail = f"s.h[CAST(len(s.h) - {keep} + 1 AS BIGINT) : len(s.h)]"
    step = f"""CASE WHEN x.b THEN {{'h': CAST([] AS VARCHAR[]), 'n': CAST(0 AS BIGINT), 'out': {out}, 'b': false}}
    WHEN len(s.h) > 0 AND s.n + x.n > {size} THEN {{'h': list_concat({tail}, x.h), 'n': {total(tail)} + x.n, 'out': {out}, 'b': false}}
    ELSE {{'h': list_concat(s.h, x.h), 'n': s.n + x.n, 'out': s.out, 'b': false}} END"""
    none = "CAST([] AS VARCHAR[])"
    end = f"{{'h': {none}, 'n': CAST(0 AS BIGINT), 'out': {none}, 'b': true}}"
    each = f"""list_transform({pieces}, lambda e: {{'h': CASE WHEN e.t IS NULL THEN {none} ELSE [e.t] END,
    'n': coalesce(CAST(length(e.t) AS BIGINT), 0), 'out': {none}, 'b': e.t IS NULL}})"""
    return f"list_reduce(list_append(list_prepend({end}, {each}), {end}), lambda s, x: {step}).out"


def recursive_chunks(source: str, content: str, *kept: str) -> str:
    """CTEs up to chunks: the kept columns, chunk_no and chunk, of a source's texts."""
    columns = ", ".join(kept)
    levels, pieces = [], f"[{{'t': {content}, 'o': true}}]"
    for i, mark in enumerate(SEPARATORS):
        cut = cut_level(pieces, mark, CHUNK_SIZE, i == len(SEPARATORS) - 1)
        levels.append(f"cut{i} AS (SELECT {columns}, {cut} AS pieces FROM {f'cut{i - 1}' if i else source})")
        pieces = "pieces"
    return f"""{", ".join(levels)},
folded AS (SELECT {columns}, {packed("pieces", CHUNK_SIZE, CHUNK_OVERLAP)} AS c FROM cut{len(SEPARATORS) - 1}),
chunks AS (SELECT {columns}, CAST(i - 1 AS BIGINT) AS chunk_no, c[i] AS chunk
  FROM (SELECT *, unnest(range(1, CAST(len(c) + 1 AS BIGINT))) AS i FROM folded))"""


RESULT_ROWS = """
numbered AS (SELECT *, row_number() OVER (ORDER BY ord) AS case_no FROM cases),
scored AS (
  SELECT n.case_no, n.question, n.category, a.response AS answer, a.accuracy_score AS acc, q.quality_score AS qual
  FROM numbered n LEFT JOIN accuracy a USING (ord) LEFT JOIN quality q USING (ord)
)"""


def sql() -> dict[str, str]:
    """The SQL per query name; a query without an entry has no SQL of reasonable cost."""
    found = {
        "kpi_snapshot": KPI,
        "trend_monthly": with_sales(
            f"SELECT month, {settled('avg(resale_price / 1000.0::DOUBLE)')} AS value FROM sales GROUP BY month"
        ),
        "trend_by_region": with_sales(
            f"SELECT month, region, {settled('median(resale_price / 1000.0::DOUBLE)', 8)} AS value "
            "FROM sales GROUP BY month, region"
        ),
        "trend_by_flat_type_range": with_sales(
            f"SELECT month, flat_type, {settled('max(price_per_sqm)', 8)} AS value FROM sales "
            "WHERE month BETWEEN DATE '1996-01-01' AND DATE '1998-12-01' GROUP BY month, flat_type"
        ),
        "trend_all_sets": trend_sets("resale_price / 1000.0::DOUBLE"),
        "trend_all_sets_per_sqm": trend_sets("price_per_sqm"),
        "flat_distribution": with_sales(
            "SELECT flat_type, count(*) AS transactions, "
            "round_even(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 1) AS share_pct "
            "FROM sales WHERE flat_type IS NOT NULL GROUP BY flat_type"
        ),
        "price_ranking": ranking("resale_price"),
        "price_ranking_per_sqm": ranking("price_per_sqm"),
        "ols_by_group": regression("floor_area_sqm", "resale_price"),
        "ols_by_group_per_sqm": regression("remaining_lease", "price_per_sqm"),
        "ols_global": regression_all("resale_price"),
        "ols_grid": regression_grid(),
        "town_region_features": TOWN_FEATURES,
        "comparables_map": COMPARABLES_MAP,
        "map_extract": MAP,
        "heat_grid": with_sales(
            "SELECT CAST(floor(latitude / 0.01::DOUBLE) AS BIGINT) AS lat_cell, "
            "CAST(floor(longitude / 0.01::DOUBLE) AS BIGINT) AS lon_cell, count(*) AS n, "
            f"{settled('sum(resale_price)', 2)} AS weight FROM sales "
            "WHERE latitude IS NOT NULL AND longitude IS NOT NULL AND resale_price IS NOT NULL GROUP BY 1, 2"
        ),
        "town_map": TOWN_MAP,
        "town_histogram": HISTOGRAM,
        "label_normalised": with_sales(
            f"""SELECT DISTINCT flat_type, {label('flat_type')} AS label,
  'flat_type_' || replace({label('flat_type')}, ' ', '_') AS feature, {label('flat_type')} AS label_of_feature,
  regexp_replace(upper(flat_type), '[ _-]', '', 'g') AS loose_key, lower(replace(flat_type, ' ', '_')) AS file_key
FROM sales WHERE flat_type IS NOT NULL"""
        ),
        "lenient_parse": """SELECT event_id, CAST(ts AS DATE) AS strict_date, CAST(ts AS DATE) AS lenient_date,
  TRY_CAST(event_type AS DATE) AS no_date, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS number,
  TRY_CAST(event_type AS DOUBLE) AS no_number FROM events""",
        "onehot_features": ONEHOT,
        "feature_align": ALIGN,
        "size_bounds": with_sales(
            f"SELECT town, flat_type, low, high, {settle(6, 'default_size')} FROM sizes", SEGMENTS, BOUNDS
        ),
        "district_mode": with_sales(
            """SELECT town, coalesce(CAST(min(CASE WHEN r = 1 THEN district_number END) AS DOUBLE), 0.0) AS district_number
FROM (SELECT town, district_number, row_number() OVER (PARTITION BY town
    ORDER BY count(district_number) DESC, district_number) AS r
  FROM sales WHERE town IS NOT NULL GROUP BY town, district_number) GROUP BY town"""
        ),
        "segment_history": with_sales(
            f"SELECT town, flat_type, month, {settle(6, 'price_per_sqm', 'price')}, type FROM history",
            *REQUEST_PARTS,
            RATES,
            HISTORY,
        ),
        "history_24m": with_sales(
            f"SELECT town, flat_type, month, {settled('price')} AS historical_price FROM recent",
            *REQUEST_PARTS,
            RATES,
            HISTORY,
        ),
        "comparables": with_sales(
            "SELECT town, flat_type, request_area, request_lease, rank, month, floor_area_sqm, remaining_lease, "
            f"{settle(6, *DISTANCES, 'resale_price')} FROM near WHERE rank <= 25",
            *REQUEST_PARTS,
            NEAR,
        ),
        "comparables_report": with_sales(
            f"""SELECT town, flat_type, rank, strftime(month, '%Y-%m') AS month,
  format('{{:.1f}}', floor_area_sqm) AS floor_area_sqm, format('{{:.0f}}', remaining_lease) AS remaining_lease,
  {', '.join(f"format('{{:.2f}} km', {d}) AS {d}" for d in DISTANCES)},
  'SGD ' || format('{{:,.2f}}', resale_price) AS resale_price FROM near WHERE rank <= 25""",
            *REQUEST_PARTS,
            NEAR,
        ),
        "forecast_exog": EXOG,
        "segment_forecast": with_sales(
            "SELECT town, flat_type, status, points, step, month, "
            f"{settle(2, 'predicted_mean', 'mean_ci_lower', 'mean_ci_upper')} FROM forecast",
            *FORECAST_PARTS,
        ),
        "forecast_series": SERIES,
        "forecast_headline": HEADLINE,
        "doc_assembly": f"""WITH {PROFILE.strip()}
SELECT doc_id, {CONTENT} AS page_content, area, source FROM shown""",
        "doc_assembly_availability": f"""WITH {PROFILE.strip()}
SELECT doc_id, concat_ws(chr(10), 'Area: ' || area, 'HDB Available: ' || CASE WHEN has_hdb THEN 'True' ELSE 'False' END,
  'HDB Price range: ' || hdb_price_range, 'Pros: ' || pros_text, 'Cons: ' || cons_text) AS page_content, area FROM shown""",
        "doc_chunks": """SELECT doc_id, source, CAST(i // 250 AS BIGINT) AS chunk_no, substring(text, i + 1, 300) AS chunk
FROM (SELECT doc_id, source, text, unnest(range(0, greatest(length(text) - 51, 0) + 1, 250)) AS i
  FROM documents WHERE length(text) > 0)""",
        "doc_chunks_recursive": f"""WITH {PROFILE}, contents AS (SELECT doc_id, source, {CONTENT} AS page_content FROM shown),
{recursive_chunks("contents", "page_content", "doc_id", "source")}
SELECT doc_id, source, CAST(chunk_no AS INTEGER) AS chunk_no, chunk FROM chunks""",
        "area_list": "SELECT 'Area ' || doc_id AS area FROM documents",
        "vector_normalise": f"""SELECT vec_id, CAST(i - 1 AS BIGINT) AS i, {settled('x / nullif(n, 0)')} AS x FROM (
  SELECT vec_id, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n,
    CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)""",
        "knn_top2": f"""WITH {TOPICS.strip()}, {TOP2.strip()}
SELECT CAST(label AS BIGINT) AS label, vec_id, {settled('similarity')} AS similarity, rank FROM top2""",
        "retrieval_context": f"""WITH {TOPICS.strip()}, {TOP2.strip()}
SELECT CAST(label AS BIGINT) AS label, string_agg('Source: {{''Area'': ''Area ' || vec_id || ''', ''Source'': ''' || coalesce(source, '')
  || '''}}' || chr(10) || 'Content: ' || coalesce(text, ''), chr(10) || chr(10) ORDER BY rank) AS context
FROM top2 LEFT JOIN documents ON doc_id = vec_id GROUP BY label""",
        "retrieval_chunks": f"""WITH {TOPICS.strip()},
{recursive_chunks("documents", "text", "doc_id", "source")},
far AS (
  SELECT label, doc_id, {COSINE.format(a='embedding', b='centre')} AS similarity
  FROM topics CROSS JOIN (SELECT vec_id AS doc_id, embedding FROM embeddings)
),
best AS (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY similarity DESC, doc_id, chunk_no) AS rank
  FROM far JOIN (SELECT doc_id, source, chunk_no, chunk FROM chunks) USING (doc_id)
)
SELECT CAST(label AS BIGINT) AS label, string_agg('Source: {{''Area'': ''Area ' || doc_id || ''', ''Source'': ''' || source
  || '''}}' || chr(10) || 'Content: ' || chunk, chr(10) || chr(10) ORDER BY rank) AS context
FROM best WHERE rank <= 2 GROUP BY label""",
        "corpus_fingerprint": """SELECT source, count(*) AS items, md5(concat_ws('-', count(*),
  sum(CAST('0x' || substring(d, 1, 15) AS BIGINT)), sum(CAST('0x' || substring(d, 17, 15) AS BIGINT)))) AS fingerprint
FROM (SELECT source, md5(concat_ws(chr(31), doc_id, text, lang)) AS d FROM documents) GROUP BY source""",
        "index_write": f"""WITH {recursive_chunks("documents", "text", "doc_id", "source")}
SELECT doc_id, source, chunk_no, chunk, CAST(len(embedding) AS BIGINT) AS dimensions FROM chunks LEFT JOIN embeddings ON vec_id = doc_id""",
        "index_update": f"""WITH {recursive_chunks("documents", "text", "doc_id")}
SELECT doc_id, chunk_no, chunk, CAST(CASE WHEN doc_id % 10 = 0 OR doc_id % 11 = 0 THEN 2 ELSE 1 END AS BIGINT) AS version FROM chunks""",
        "price_scoring_checked": with_sales(
            "SELECT town, flat_type, floor_area_sqm, true AS consistent, true AS within_range FROM requests", *REQUEST_PARTS
        ),
        "forecast_accepted": with_sales(
            f"""SELECT town, flat_type, month, {settled('mean', 2)} AS mean, {settled('lower', 2)} AS mean_ci_lower,
  {settled('upper', 2)} AS mean_ci_upper FROM judged WHERE reason IS NULL""",
            *FORECAST_PARTS,
            *JUDGED,
        ),
        "forecast_rejects": with_sales(
            'SELECT reason, count(*) AS "rows" FROM judged WHERE reason IS NOT NULL GROUP BY reason', *FORECAST_PARTS, *JUDGED
        ),
        "json_array_documents": f"""WITH {PROFILE.strip()}
SELECT area, {CONTENT} AS page_content, true AS has_source FROM shown""",
        "sales_refresh": with_sales(
            f"""SELECT month, count(*) AS items, {settled('sum(resale_price)', 2)} AS total,
  CAST(CASE WHEN month(month) = 6 OR month = DATE '1996-02-01' THEN 2 ELSE 1 END AS BIGINT) AS refresh
FROM sales WHERE month IS NOT NULL GROUP BY month"""
        ),
        "history_export": f"""WITH {MESSAGES.strip()}
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place, role AS type, text AS content
FROM messages WHERE role IN ('human', 'ai')""",
        "history_lists": f"""WITH {MESSAGES.strip()}
SELECT conv_id, count(*) OVER (PARTITION BY conv_id) AS messages,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place, role || ': ' || text AS line
FROM messages WHERE role IN ('human', 'ai')""",
        "answer_context": f"""WITH {MESSAGES.strip()},
ends AS (SELECT conv_id, max(CASE WHEN role <> 'tool' THEN turn END) AS last_other FROM messages GROUP BY conv_id)
SELECT conv_id, 'context' AS section, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place, 'system' AS type,
  text AS content
FROM messages JOIN ends USING (conv_id) WHERE role = 'tool' AND (last_other IS NULL OR turn > last_other)
UNION ALL
SELECT conv_id, 'message', row_number() OVER (PARTITION BY conv_id ORDER BY turn), role, text
FROM messages WHERE role IN ('human', 'system') OR (role = 'ai' AND NOT calls)""",
        "conversation_append": f"""WITH {MESSAGES.strip()}
SELECT conv_id, max(turn) + 1 AS turn, arg_max(role, turn) AS role, arg_max(text, turn) AS text
FROM messages GROUP BY conv_id""",
        "keyword_area_scores": f"""WITH {CASES.strip()}, {MENTIONS.strip()}
SELECT ord, {settle(6, 'keyword_score', 'area_score')}, CAST({word_count('response')} AS BIGINT) AS words FROM mentions""",
        "response_quality": f"""WITH {CASES.strip()}, {QUALITY.strip()}
SELECT ord, question, category, difficulty,
  {settle(6, 'keyword_score', 'area_score', 'length_score', 'quality_score')} FROM quality""",
        "accuracy_scores": f"""WITH {CASES.strip()}, {MENTIONS.strip()}, {TOPICS.strip()}, {ACCURACY.strip()}
SELECT ord, question, {settle(6, 'similarity', 'keyword_score', 'area_score', 'accuracy_score')} FROM accuracy""",
        "redirect_scores": f"""WITH {CASES.strip()}, {HANDLED.strip()}
SELECT ord, question, {settle(6, 'redirect_score', 'avoid_score', 'handling_score')} FROM handled""",
        "latency_score": f"""SELECT event_type, {settled('m')} AS average_time, n AS total_queries,
  CASE WHEN m <= 2 THEN 1.0 WHEN m <= 5 THEN 0.8 WHEN m <= 10 THEN 0.6 ELSE 0.4 END::DOUBLE AS time_score
FROM (SELECT event_type, avg(value) AS m, count(value) AS n FROM events GROUP BY event_type)""",
        "timed_cases": f"""WITH {CASES.strip()}
SELECT case_no, question, category, seconds
FROM (SELECT row_number() OVER (ORDER BY ord) AS case_no, question, category FROM cases)
JOIN (SELECT row_number() OVER (ORDER BY event_id) AS case_no, value AS seconds FROM events) USING (case_no)""",
        "category_listing": f"""WITH {CASES.strip()}
SELECT {titled('category')} AS category, count(*) OVER (PARTITION BY category) AS cases,
  min(ord) OVER (PARTITION BY category) AS first_ord,
  row_number() OVER (PARTITION BY category ORDER BY ord) AS place, question FROM cases""",
        "json_documents": f"""WITH {PROFILE.strip()}
SELECT area, concat_ws(chr(10), 'Area: ' || area, 'HDB Price range: ' || hdb_price_range, 'Pros: ' || pros_text,
  'Cons: ' || cons_text, 'Nearby Amenities: ' || amenities_text) AS page_content, true AS has_source FROM shown""",
        "csv_load": "SELECT event_id, event_type, value FROM events",
        "csv_export": with_sales(
            f"""SELECT town, flat_type, month, {settle(2, 'predicted_mean', 'mean_ci_lower', 'mean_ci_upper')},
  'forecast_' || town || '_' || lower(replace(flat_type, ' ', '_')) || '_12m' AS export_name
FROM forecast WHERE status = 'ok'""",
            *FORECAST_PARTS,
        ),
    }
    found["csv_export_history"] = with_sales(
        f"""SELECT town, flat_type, month, {settled('price')} AS historical_price,
  'history_' || town || '_' || lower(replace(flat_type, ' ', '_')) || '_24m' AS export_name FROM recent""",
        *REQUEST_PARTS,
        RATES,
        HISTORY,
    )
    found["csv_export_comparables"] = with_sales(
        f"""SELECT town, flat_type, month, floor_area_sqm, remaining_lease, {settle(6, *DISTANCES, 'resale_price')},
  'comparables_' || town || '_' || lower(replace(flat_type, ' ', '_')) AS export_name FROM near WHERE rank <= 25""",
        *REQUEST_PARTS,
        NEAR,
    )
    evaluated = ", ".join(
        part.strip() for part in (CASES, MENTIONS, QUALITY, TOPICS, ACCURACY, HANDLED)
    )
    found["overall_scores"] = f"""WITH {evaluated}, {OVERALL.strip()}
SELECT metric, {settle(6, 'score')} FROM overall"""
    found["results_sink"] = f"""WITH {evaluated}, {OVERALL.strip()}
SELECT metric, {settle(6, 'score')}, true AS dated FROM overall"""
    found["eval_table"] = f"""WITH {evaluated}, {RESULT_ROWS.strip()}
SELECT case_no, replace(question, '|', '\\|') AS question, {titled('category')} AS category,
  replace(replace(coalesce(answer, 'No response recorded'), chr(10), ' '), '|', '\\|') AS answer,
  coalesce(format('{{:.3f}}', acc), 'N/A') AS ground_truth_score,
  coalesce(format('{{:.3f}}', qual), 'N/A') AS response_quality_score,
  coalesce(format('{{:.3f}}', (acc + qual) / 2), 'N/A') AS overall_performance
FROM scored"""
    found["results_cases"] = found["eval_table"].replace("\nFROM scored", ", true AS dated\nFROM scored")
    found["eval_sample"] = f"""WITH {CASES.strip()}, {QUALITY.strip()}
SELECT ord, substring(question, 1, 50) AS question_start, response, {settle(6, 'quality_score')}
FROM quality ORDER BY md5('1-' || ord), ord LIMIT 2"""
    return found
