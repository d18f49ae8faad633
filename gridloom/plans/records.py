"""Queries on records: text functions, page plans, exports, validation, reviews."""

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import layers as L
from ..operators import pages as P
from ..operators import validate as V
from ..sources.tables import palette, parse_palette, part_colors, tile_cells
from .base import CELLS, PAL, PC, query


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("""SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') AS xml FROM pages""")
def xml_escape(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.xml_escape(F.col("html")).alias("xml"))


@query("""SELECT p_partkey, CASE WHEN regexp_matches(v, '[",\\r\\n]') THEN '"' || replace(v, '"', '""') || '"' ELSE v END AS field FROM (SELECT p_partkey, p_name || CASE WHEN p_partkey % 3 = 0 THEN ', "x"' ELSE '' END AS v FROM part)""")
def csv_fields(spark, sf):
    v = F.concat("p_name", F.when(F.col("p_partkey") % 3 == 0, F.lit(', "x"')).otherwise(F.lit("")))
    return table(spark, sf, "part").select("p_partkey", X.csv_field(v).alias("field"))


@query("SELECT doc_id, 'sha256:' || sha256(text) AS id, octet_length(encode(text))::BIGINT AS n_bytes FROM documents")
def content_ids(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.sha256_id(F.col("text")).alias("id"), F.octet_length("text").cast("long").alias("n_bytes"))


@query(r"""SELECT page_id, CASE WHEN trim(n) = '' THEN 'pattern' ELSE trim(n) END AS file_name FROM (SELECT page_id, regexp_replace(url, '[\\/:*?"<>|]+', '-', 'g') AS n FROM pages)""")
def safe_names(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.safe_file_name(F.col("url")).alias("file_name"))


@query(r"""SELECT page_id, left(CASE WHEN trim(n) = '' THEN 'Sheet' ELSE trim(n) END, 31) AS sheet FROM (SELECT page_id, regexp_replace(url, '[\\/*?:\[\]]', ' ', 'g') AS n FROM pages)""")
def sheet_names(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.sheet_name(F.col("url")).alias("sheet"))


@query("""SELECT p_partkey, n, CASE WHEN n <= 26 THEN chr(64 + n) WHEN n <= 702 THEN chr(64 + (n - 1) // 26) || chr(65 + (n - 1) % 26)
  ELSE chr(65 + (n - 703) // 676) || chr(65 + (n - 703) // 26 % 26) || chr(65 + (n - 703) % 26) END AS name FROM (SELECT p_partkey, (p_partkey % 18278 + 1)::INT AS n FROM part)""")
def column_names(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", (F.col("p_partkey") % 18278 + 1).cast("int").alias("n"))
    return rows.select("p_partkey", "n", X.column_name(F.col("n")).alias("name"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
  regexp_replace(regexp_replace(printf('%.4f', floor(l_extendedprice * 0.03125 * 10000 + 0.5) / 10000), '0+$', ''), '\\.$', '') AS mm FROM lineitem""".replace("\\\\", "\\"))
def fixed_numbers(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", X.fixed4(F.col("l_extendedprice") * 0.03125).alias("mm"))


@query(r"""SELECT doc_id, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i), ' ') AS codes FROM (SELECT doc_id, list_filter(regexp_split_to_array(upper(regexp_replace(text, '[^A-Za-z,\s]', '', 'g')), '[\s,，]+'), lambda x: x <> '') AS w FROM documents)""")
def code_lists(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(X.parse_codes(F.regexp_replace("text", r"[^A-Za-z,\s]", "")), " ").alias("codes"))


@query("""SELECT a.p_partkey, round(levenshtein(a.p_name, b.p_name) / length(a.p_name)::DOUBLE, 6) AS cer FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1""")
def character_error_rates(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_name")
    after = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("next"))
    return part.join(after, "p_partkey").select("p_partkey", F.round(X.character_error_rate(F.col("p_name"), F.col("next")), 6).alias("cer"))


@query(f"WITH {PC}, h AS (SELECT CASE WHEN r % 3 = 0 THEN 'ZG' ELSE '' END || chr(65 + g % 25) || b || '0' || r AS code, r, g, b FROM pc WHERE b % 16 <> 0) SELECT code, CASE WHEN code LIKE 'ZG%' THEN 'ZG' ELSE left(code, 1) END AS grp, r, g, b FROM h")
def parsed_palette(spark, sf):
    """Lines of a colour for each part; some are blank."""
    r, g, b = (F.col(c) for c in "rgb")
    code = F.concat(F.when(r % 3 == 0, "ZG").otherwise(""), F.char(65 + g % 25), b.cast("string"), F.lit("0"), r.cast("string"))
    line = F.when(b % 16 == 0, "   ").otherwise(F.format_string("%s , #%02x%02X%02x", code, r, g, b))
    return parse_palette(part_colors(spark, sf).select(line.alias("value")))


@query(f"""WITH {PC}, n AS (SELECT id, 'K' || g AS code, r, g, b FROM pc WHERE r % 3 < 2), m AS (SELECT id, 'XK' || g AS code, 255 - r AS r, g, b FROM pc WHERE r % 3 > 0)
SELECT coalesce(m.id, n.id) AS id, coalesce(m.code, n.code) AS code, coalesce(m.r, n.r) AS r, coalesce(m.g, n.g) AS g, coalesce(m.b, n.b) AS b FROM n FULL JOIN m ON n.id = m.id""")
def palette_union(spark, sf):
    pal = part_colors(spark, sf).select("id", F.concat(F.lit("K"), F.col("g").cast("string")).alias("code"), "r", "g", "b")
    low = pal.where("r % 3 < 2")
    high = pal.where("r % 3 > 0").select("id", F.concat(F.lit("X"), "code").alias("code"), (255 - F.col("r")).alias("r"), "g", "b")
    return L.union_palettes(low, high, "id")


# pages


@query("""WITH g AS (SELECT o_orderkey AS grid_id, (o_orderkey % 97 + 1)::INT AS width, (o_custkey % 89 + 1)::INT AS height FROM orders),
y AS (SELECT *, unnest(range(0, greatest(0, ceil((height - 46) / 45.0))::INT + 1)) * 45 AS y FROM g), x AS (SELECT *, unnest(range(0, greatest(0, ceil((width - 36) / 35.0))::INT + 1)) * 35 AS x FROM y)
SELECT grid_id, x::INT AS x, y::INT AS y, least(36, width - x)::INT AS columns, least(46, height - y)::INT AS rows, (row_number() OVER (PARTITION BY grid_id ORDER BY y, x) - 1)::INT AS page FROM x""")
def page_plan(spark, sf):
    grids = table(spark, sf, "orders").select(F.col("o_orderkey").alias("grid_id"), (F.col("o_orderkey") % 97 + 1).cast("int").alias("width"), (F.col("o_custkey") % 89 + 1).cast("int").alias("height"))
    return P.page_plan(grids).select("grid_id", "x", "y", "columns", "rows", "page")


@query("SELECT o_orderkey, (ceil((o_orderkey % 97 + 1) / 29.0) * ceil((o_custkey % 89 + 1) / 29.0))::BIGINT AS boards FROM orders")
def board_counts(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", (F.ceil((F.col("o_orderkey") % 97 + 1) / 29) * F.ceil((F.col("o_custkey") % 89 + 1) / 29)).cast("long").alias("boards"))


@query(f"""WITH {CELLS}, e AS (SELECT grid_id, min(x) AS l, max(x) AS r, min(y) AS t, max(y) AS b FROM cells WHERE color IS NOT NULL GROUP BY 1)
SELECT grid_id, r - x AS x, y - t AS y, r - l + 1 AS width, b - t + 1 AS height, color FROM cells JOIN e USING (grid_id) WHERE x BETWEEN l AND r AND y BETWEEN t AND b""")
def export_grid_mirrored(spark, sf):
    return P.export_grid(tile_cells(spark, sf), True)


@query(f"""WITH {CELLS}, {PAL} SELECT grid_id, x, y, '<rect x="' || mm(x * 2.6::DOUBLE) || '" y="' || mm(y * 2.6::DOUBLE) || '" width="2.6" height="2.6" fill="' || printf('#%02X%02X%02X', r, g, b) || '"><title>' || code || '</title></rect>' AS svg
FROM cells JOIN pal ON pal.id = 'c' || lpad(substr(color, 2), 2, '0')""".replace("mm(x * 2.6::DOUBLE)", "regexp_replace(regexp_replace(printf('%.4f', x * 2.6::DOUBLE), '0+$', ''), '[.]$', '')").replace("mm(y * 2.6::DOUBLE)", "regexp_replace(regexp_replace(printf('%.4f', y * 2.6::DOUBLE), '0+$', ''), '[.]$', '')"))
def svg_cells(spark, sf):
    named = F.when(F.col("color").isNotNull(), F.concat(F.lit("c"), F.lpad(F.substring("color", 2, 9), 2, "0")))
    return P.svg_cells(tile_cells(spark, sf).withColumn("color", named), palette(spark), 2.6)


@query("""SELECT p_brand || ',' || coalesce(CASE WHEN p_type LIKE '%,%' THEN '"' || p_type || '"' ELSE p_type END, '') || ',' || count(*) AS line FROM part GROUP BY p_brand, p_type""")
def bom_csv_lines(spark, sf):
    rows = table(spark, sf, "part").groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"))
    return P.csv_lines(rows, ["p_brand", "p_type", "n"])


@query("""WITH d AS (SELECT DISTINCT toxic, doc_id, doc_id - row_number() OVER (PARTITION BY toxic ORDER BY doc_id) AS g FROM labels) SELECT toxic, min(doc_id) AS start, count(*)::BIGINT AS length FROM d GROUP BY toxic, g""")
def rle_runs(spark, sf):
    return P.runs(table(spark, sf, "labels"), "toxic", "doc_id")


@query("SELECT toxic, doc_id AS idx FROM labels")
def rle_expand(spark, sf):
    return P.expand_runs(P.runs(table(spark, sf, "labels"), "toxic", "doc_id")).select("toxic", "idx")


@query("""SELECT p_partkey, n, array_to_string(list_sort(list_distinct(list_concat(flatten(list_transform(range(0, (n + 28) // 29), lambda s: list_transform(list_filter(range(0, 29, 5), lambda o: s * 29 + o < n), lambda o: s * 29 + o))), [n - 1]))), ',') AS guides FROM (SELECT p_partkey, (p_size * 4 + p_partkey % 29)::INT AS n FROM part)""")
def guide_lines(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", (F.col("p_size") * 4 + F.col("p_partkey") % 29).cast("int").alias("n"))
    starts = F.transform(F.sequence(F.lit(0), F.ceil(F.col("n") / 29).cast("int") - 1), lambda s: F.transform(F.array(*[F.lit(o) for o in range(0, 29, 5)]), lambda o: s * 29 + o))
    cells = F.array_sort(F.array_distinct(F.concat(F.filter(F.flatten(starts), lambda c: c < F.col("n")), F.array(F.col("n") - 1))))
    return rows.select("p_partkey", "n", F.array_join(F.transform(cells, lambda c: c.cast("string")), ",").alias("guides"))


@query(f"WITH {CELLS} SELECT grid_id, idx, round((x - 3.5)::DOUBLE * 0.72, 6) AS px, round((3.5 - y)::DOUBLE * 0.72, 6) AS py FROM cells WHERE color IS NOT NULL")
def bead_placement(spark, sf):
    rows = tile_cells(spark, sf).where("color IS NOT NULL")
    return rows.select("grid_id", "idx", F.round((F.col("x") - 3.5) * 0.72, 6).alias("px"), F.round((3.5 - F.col("y")) * 0.72, 6).alias("py"))


# validation

@query("WITH " + PC + """, p AS (SELECT CASE WHEN r % 16 = 5 THEN 'p' || b ELSE id END AS id, 'K' || id || g % 2 AS code, CASE WHEN b % 64 = 1 THEN r + 250 ELSE r END AS r, g - 5 AS g, b FROM pc
  UNION ALL SELECT id || 'x', 'K' || id || '1', r, g, b FROM pc WHERE g % 4 = 0)
SELECT 'repeated id' AS rule, id AS value FROM p GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'repeated code', code FROM p GROUP BY code HAVING count(*) > 1
UNION ALL SELECT 'channel out of range', id FROM p WHERE NOT (r BETWEEN 0 AND 255 AND g BETWEEN 0 AND 255 AND b BETWEEN 0 AND 255)""")
def palette_violations(spark, sf):
    """Colours of parts with some ids and codes given twice and channels out of range."""
    pc = part_colors(spark, sf)
    own = pc.select(
        F.when(F.col("r") % 16 == 5, F.concat(F.lit("p"), F.col("b").cast("string"))).otherwise(F.col("id")).alias("id"), F.concat(F.lit("K"), "id", (F.col("g") % 2).cast("string")).alias("code"),
        F.when(F.col("b") % 64 == 1, F.col("r") + 250).otherwise(F.col("r")).alias("r"), (F.col("g") - 5).alias("g"), "b",
    )
    more = pc.where("g % 4 = 0").select(F.concat("id", F.lit("x")).alias("id"), F.concat(F.lit("K"), "id", F.lit("1")).alias("code"), "r", "g", "b")
    return V.palette_violations(own.unionByName(more))


@query("""WITH r AS (SELECT l_orderkey AS k, (l_partkey % 50)::INT AS start, (l_suppkey % 9)::INT AS length FROM lineitem),
b AS (SELECT *, lag(start + length) OVER (PARTITION BY k ORDER BY start, length) AS e FROM r),
v AS (SELECT k, start, length, CASE WHEN length < 1 THEN 'empty' WHEN start + length > 52 THEN 'out of bounds' WHEN e > start THEN 'overlap' END AS rule FROM b)
SELECT rule, count(*)::BIGINT AS n FROM v WHERE rule IS NOT NULL GROUP BY 1""")
def run_violations(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_partkey") % 50).cast("int").alias("start"), (F.col("l_suppkey") % 9).cast("int").alias("length"))
    return V.run_violations(rows, "k", 52).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH l AS (SELECT l_orderkey AS grid_id, (l_partkey % 16)::INT AS idx, CASE WHEN l_linenumber = 1 THEN '(empty)' ELSE l_returnflag END AS c FROM lineitem)
SELECT grid_id, idx, string_agg(DISTINCT c, ',' ORDER BY c) AS colors FROM l GROUP BY 1, 2 HAVING count(DISTINCT c) > 1""")
def lock_conflicts(spark, sf):
    rows = table(spark, sf, "lineitem")
    color = F.when(F.col("l_linenumber") != 1, F.col("l_returnflag"))
    return V.lock_conflicts(rows.select(F.col("l_orderkey").alias("grid_id"), (F.col("l_partkey") % 16).cast("int").alias("idx"), color.alias("color")))


@query("""WITH g AS (SELECT source, avg(quality) AS q, avg(toxic) AS t FROM labels JOIN documents USING (doc_id) GROUP BY 1)
SELECT 'quality' AS metric, round(avg(q), 9) AS mean, count(*)::BIGINT AS groups FROM g UNION ALL SELECT 'toxic', round(avg(t), 9), count(*)::BIGINT FROM g""")
def review_summary(spark, sf):
    ratings = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    return V.review_summary(ratings, "source", ["quality", "toxic"]).select("metric", F.round("mean", 9).alias("mean"), "groups")


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1")
def latest_tickets(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))
