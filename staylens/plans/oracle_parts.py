"""Common table expressions of the oracle SQL: the same entities as ``sources.standins``."""

from __future__ import annotations


def stays(kind: str) -> str:
    return f"""
{kind}_raw AS (
  SELECT row_number() OVER () AS row,
         concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS {kind}_id,
         l_partkey AS hotel_id,
         CAST(o_orderdate AS DATE) AS date,
         CAST(l_shipdate AS DATE) AS check_in,
         CAST(l_shipdate AS DATE) + CAST(l_linenumber - 1 AS INTEGER) AS check_out,
         CASE WHEN CAST(l_quantity AS INTEGER) = 50 THEN NULL
              WHEN CAST(l_quantity AS INTEGER) % 5 = 0 THEN concat(l_linenumber, ':')
              WHEN CAST(l_quantity AS INTEGER) % 5 = 1 THEN
                   concat(l_linenumber, ':', CAST(l_quantity AS INTEGER) % 18, ',', l_linenumber, '|1')
              WHEN CAST(l_quantity AS INTEGER) % 5 = 2 THEN
                   concat(1 + l_linenumber % 3, '|2:', CAST(l_quantity AS INTEGER) % 18)
              WHEN CAST(l_quantity AS INTEGER) % 5 = 3 THEN concat('x', l_linenumber)
              ELSE concat(l_linenumber) END AS room_description,
         l_extendedprice AS total_usd,
         CAST(1 + l_suppkey % 3 AS INTEGER) AS nb_rooms
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
),
{kind}_time AS (
  SELECT *, CAST(month(date) AS INTEGER) AS {kind}_month,
         CAST(month(check_in) AS INTEGER) AS checkin_month,
         CAST(date_diff('day', check_in, check_out) AS INTEGER) AS bookdays,
         CAST(date_diff('day', date, check_in) AS INTEGER) AS {kind}days
  FROM {kind}_raw
),
{kind}_room AS (
  SELECT row, string_split(room, ':') AS parts
  FROM (SELECT row, unnest(string_split(room_description, '|')) AS room FROM {kind}_raw)
),
{kind}_guests AS (
  SELECT row, sum(TRY_CAST(parts[1] AS DOUBLE)) AS tot_adults,
         CAST(sum(CASE WHEN len(parts) > 1 THEN len(string_split(parts[2], ',')) ELSE 0 END)
              AS BIGINT) AS tot_kids
  FROM {kind}_room GROUP BY row
),
{kind}_priced AS (
  SELECT t.*, tot_adults, tot_kids, CAST(tot_kids AS DOUBLE) / 2 AS kids_eq,
         CAST(tot_kids AS DOUBLE) / 2 + tot_adults AS tot_guests,
         total_usd / nullif(bookdays, 0) / nullif(nb_rooms, 0)
             / nullif(CAST(tot_kids AS DOUBLE) / 2 + tot_adults, 0) AS price
  FROM {kind}_time t JOIN {kind}_guests g USING (row)
),
{kind} AS (
  SELECT DISTINCT {kind}_id, hotel_id, coalesce(checkin_month, 0) AS checkin_month,
         coalesce({kind}_month, 0) AS {kind}_month, coalesce({kind}days, 0) AS {kind}days,
         coalesce(price, 0) AS "effUSD"
  FROM {kind}_priced
)"""


HOTEL_RAW = """
hotel_raw AS (
  SELECT p_partkey AS hotel_id, p_partkey % 25 AS place_id,
         CASE WHEN p_size % 10 <> 0 THEN concat_ws('|', p_size % 4, replace(p_brand, 'Brand#', ''),
              split_part(p_name, ' ', 1),
              ['nan', '1d', 'inf', '2.5'][1 + p_partkey % 4], p_size) END AS themes,
         CASE WHEN p_size % 7 <> 0 THEN concat_ws('|', p_size % 3, split_part(p_name, ' ', 2),
              p_size) END AS facilities,
         p_size % 13 AS rating,
         CASE WHEN p_size % 11 <> 0 THEN p_size * 10 END AS number_of_reviews,
         CAST(length(p_type) AS INTEGER) AS property_type,
         CAST(p_size % 11 AS DOUBLE) AS cleanliness_rating,
         CAST((p_size + 1) % 11 AS DOUBLE) AS service_rating,
         CASE WHEN p_size % 9 <> 0 THEN CAST(p_size % 7 AS DOUBLE) END AS facilities_rating,
         p_retailprice / CAST(100 AS DOUBLE) AS location_rating,
         CAST(10 AS DOUBLE) AS pricing_rating,
         p_size / CAST(5 AS DOUBLE) AS rooms_rating,
         CASE WHEN p_size % 8 <> 0 THEN CAST(3.5 AS DOUBLE) END AS dining_rating,
         (p_size % 5) * CAST(1.5 AS DOUBLE) AS overall_rating,
         CAST(p_size AS DOUBLE) AS popularity,
         p_retailprice AS min_rate_usd,
         CASE WHEN p_size % 12 <> 0
              THEN DATE '2018-01-01' + CAST(p_partkey % 365 AS INTEGER) END AS cheapest_check_in
  FROM part
)"""

PLACE = """
place AS (
  SELECT CAST(n_nationkey AS BIGINT) AS place_id, n_regionkey AS place_type_id,
         n_nationkey * CAST(1.5 AS DOUBLE) - CAST(20 AS DOUBLE) AS latitude,
         n_regionkey * CAST(10 AS DOUBLE) AS longitude,
         CAST(n_nationkey % 7 AS DOUBLE) AS rank
  FROM nation
)"""

THEMES = r"""
theme AS (
  SELECT hotel_id, CAST(sum(CASE WHEN regexp_full_match(token, '[+-]?[0-9]+(\.[0-9]+)?')
                        AND TRY_CAST(token AS DOUBLE) > 0 THEN 1 ELSE 0 END) AS BIGINT)
         AS tot_themes
  FROM (SELECT hotel_id, unnest(string_split(themes, '|')) AS token FROM hotel_raw)
  GROUP BY hotel_id
)"""

FACILITIES = r"""
facility AS (
  SELECT hotel_id, CAST(sum(CASE WHEN regexp_full_match(token, '[+-]?[0-9]+(\.[0-9]+)?')
                        AND TRY_CAST(token AS DOUBLE) > 0 THEN 1 ELSE 0 END) AS BIGINT)
         AS tot_facilities
  FROM (SELECT hotel_id, unnest(string_split(facilities, '|')) AS token FROM hotel_raw)
  GROUP BY hotel_id
)"""

MEAN_RATING = """(coalesce(cleanliness_rating, 0) + coalesce(service_rating, 0)
      + coalesce(facilities_rating, 0) + coalesce(location_rating, 0) + coalesce(rooms_rating, 0)
      + coalesce(dining_rating, 0) + coalesce(overall_rating, 0)) / 7"""

HOTEL = f"""{HOTEL_RAW},{THEMES},{FACILITIES},
hotel AS (
  SELECT hotel_id, place_id, rating, number_of_reviews, popularity, property_type, min_rate_usd,
         CAST(month(cheapest_check_in) AS INTEGER) AS cheapest_month,
         {MEAN_RATING} AS mean_rating, tot_themes, tot_facilities,
         {MEAN_RATING} * number_of_reviews AS effrat
  FROM hotel_raw LEFT JOIN theme USING (hotel_id) LEFT JOIN facility USING (hotel_id)
)"""

SUPPORT = f"""{HOTEL},{PLACE},
support AS (SELECT * FROM place JOIN hotel USING (place_id))"""

BRAND = """
brand AS (
  SELECT p_partkey AS hotel_id, CAST(replace(p_brand, 'Brand#', '') AS INTEGER) AS cluster_id
  FROM part
)"""

HOTEL_SIDE = """effrat, rating, popularity, property_type, place_type_id, rank, tot_facilities,
       tot_themes"""

CLUSTER_MATRIX = f"""{SUPPORT},
matrix AS (
  SELECT DISTINCT hotel_id, coalesce(CAST(effrat AS DOUBLE), 0) AS effrat,
         coalesce(CAST(rating AS DOUBLE), 0) AS rating,
         coalesce(CAST(popularity AS DOUBLE), 0) AS popularity,
         coalesce(CAST(property_type AS DOUBLE), 0) AS property_type,
         coalesce(CAST(place_type_id AS DOUBLE), 0) AS place_type_id,
         coalesce(CAST(rank AS DOUBLE), 0) AS rank,
         coalesce(CAST(tot_facilities AS DOUBLE), 0) AS tot_facilities,
         coalesce(CAST(tot_themes AS DOUBLE), 0) AS tot_themes,
         coalesce(CAST(latitude AS DOUBLE), 0) AS latitude,
         coalesce(CAST(longitude AS DOUBLE), 0) AS longitude
  FROM support
)"""

LABELLED = f"""{SUPPORT},{BRAND},{stays("lead")},
clustered AS (
  SELECT lead_id, hotel_id, cluster_id, checkin_month, lead_month, leaddays, "effUSD",
         {HOTEL_SIDE}
  FROM lead JOIN support USING (hotel_id) JOIN brand USING (hotel_id)
),
cluster_mean AS (
  SELECT cluster_id, avg("effUSD") AS "meanUSD" FROM clustered GROUP BY cluster_id
),
labelled AS (
  SELECT clustered.*, "meanUSD",
         CAST(CASE WHEN "meanUSD" >= "effUSD" THEN 1 ELSE 0 END AS INTEGER) AS gooddeal
  FROM clustered JOIN cluster_mean USING (cluster_id)
)"""

RATINGS = """
rated AS (
  SELECT user_id AS "user", CAST(json_extract_string(props, '$.k') AS INTEGER) AS item,
         CAST(sum(CAST(value AS DECIMAL(18, 2))) AS DOUBLE) / count(value) AS rating
  FROM events GROUP BY 1, 2
)"""


def pairs(num_users: int) -> str:
    return f"""{RATINGS},
pairs AS (
  SELECT u."user", i.item
  FROM (SELECT unnest(range(1, {num_users} + 1)) AS "user") u
  CROSS JOIN (SELECT DISTINCT item FROM rated) i
),
unrated AS (
  SELECT p."user", p.item FROM pairs p
  WHERE NOT EXISTS (SELECT 1 FROM rated r WHERE r."user" = p."user" AND r.item = p.item)
)"""


TOKENS = r"""
token AS (
  SELECT item, feature FROM (
    SELECT doc_id AS item, lang,
           unnest(regexp_split_to_array(lower(text), '[ \t\n\x0B\f\r]+')) AS feature
    FROM documents)
  WHERE feature <> ''
)"""

TFIDF = f"""{TOKENS},
tf AS (SELECT item, feature, count(*) AS tf FROM token GROUP BY item, feature),
df AS (SELECT feature, count(*) AS df FROM tf GROUP BY feature),
idf AS (
  SELECT feature, df,
         ln(CAST((SELECT count(*) FROM documents) + 1 AS DOUBLE) / (df + 1)) AS idf
  FROM df
),
tfidf AS (
  SELECT item, feature, tf, tf * idf AS tfidf FROM tf JOIN idf USING (feature)
)"""

DISTINCT_TOKENS = r"""
listed AS (
  SELECT doc_id AS item, regexp_split_to_array(lower(text), '[ \t\n\x0B\f\r]+') AS words
  FROM documents
),
placed AS (
  SELECT item, unnest(words) AS feature, generate_subscripts(words, 1) AS place FROM listed
),
first_use AS (
  SELECT item, feature, min(place) AS first FROM placed WHERE feature <> '' GROUP BY item, feature
)"""
