"""Profiles, audits and catalogue checks over the shared tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlight.functions import tokens
from ledgerlight.operators import hash_tree
from ledgerlight.operators import quality as k
from ledgerlight.plans import bindings as b
from ledgerlight.plans.bindings import sql_ratio as q
from ledgerlight.plans.registry import query

ALL_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def stacked(frames) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


# Column, Spark type, numeric or text or other
PROFILED = {
    "orders": [("o_orderkey", "bigint", "n"), ("o_custkey", "bigint", "n"), ("o_orderstatus", "string", "t"),
               ("o_totalprice", "double", "n"), ("o_orderdate", "timestamp_ntz", "x"), ("o_orderpriority", "string", "t")],
    "events": [("event_id", "bigint", "n"), ("ts", "timestamp_ntz", "x"), ("user_id", "bigint", "n"),
               ("event_type", "string", "t"), ("value", "double", "n"), ("props", "string", "t")],
}


def profile_sql(table, col, kind, mode):
    def end(fn, m, typ):
        return f"{fn}(CAST({col} AS {typ}))" if mode == m else f"CAST(NULL AS {typ})"

    return (
        f"SELECT '{table}' AS table_name, '{col}' AS column_name, '{kind}' AS data_type, COUNT(*) AS n_rows, "
        f"COUNT(*) - COUNT({col}) AS n_nulls, {end('MIN', 'n', 'DOUBLE')} AS min_number, {end('MAX', 'n', 'DOUBLE')} AS max_number, "
        f"{end('MIN', 't', 'VARCHAR')} AS min_text, {end('MAX', 't', 'VARCHAR')} AS max_text FROM {table}"
    )


@query("profile_columns", " UNION ALL ".join(profile_sql(t, *c) for t, cols in PROFILED.items() for c in cols))
def profile_columns(t):
    return stacked(k.profile_columns(t(name), name) for name in PROFILED)


ENUMS = {"lineitem": ["l_returnflag", "l_linestatus"], "orders": ["o_orderstatus", "o_orderpriority"],
         "customer": ["c_mktsegment", "c_name"], "part": ["p_type", "p_name"]}


@query("enum_discovery", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, COUNT(DISTINCT {c}) AS n_values, string_agg(DISTINCT {c}, '|' ORDER BY {c}) AS enum_values FROM {t}"
    for t, cols in ENUMS.items() for c in cols) + ") WHERE n_values <= 12")
def enum_discovery(t):
    return stacked(k.enum_values(t(name), cols, name) for name, cols in ENUMS.items())


KEYS = {"orders.pk": ("orders", ["o_orderkey"]), "customer.pk": ("customer", ["c_custkey"]),
        "lineitem.pk": ("lineitem", ["l_orderkey", "l_linenumber"]), "conversations.pk": ("conversations", ["conv_id", "turn"])}


@query("pk_audit", " UNION ALL ".join(
    f"SELECT '{n}' AS key_name, COALESCE(SUM(c), 0)::BIGINT AS n_rows, COUNT(*) AS n_keys, COUNT(*) FILTER (WHERE c > 1) AS repeated_keys, "
    f"COALESCE(SUM(c) FILTER (WHERE {' OR '.join(f'{c} IS NULL' for c in cols)}), 0)::BIGINT AS null_key_rows "
    f"FROM (SELECT {', '.join(cols)}, COUNT(*) AS c FROM {t} GROUP BY {', '.join(cols)})"
    for n, (t, cols) in KEYS.items()))
def pk_audit(t):
    return stacked(k.key_audit(t(table), cols, name) for name, (table, cols) in KEYS.items())


LINKS = {"lineitem.order": ("lineitem", "l_orderkey", "orders", "o_orderkey"),
         "orders.customer": ("orders", "o_custkey", "customer", "c_custkey"),
         "documents.label": ("documents", "doc_id", "labels", "doc_id"),
         "events.part": ("events", "event_id", "part", "p_partkey")}


@query("fk_audit", " UNION ALL ".join(
    f"SELECT '{n}' AS fk_name, COUNT(*) AS n_refs, COUNT(*) FILTER (WHERE NOT known) AS orphan_rows, COUNT(DISTINCT CASE WHEN NOT known THEN v END) AS orphan_values "
    f"FROM (SELECT {c} AS v, {c} IN (SELECT {pc} FROM {p}) AS known FROM {t} WHERE {c} IS NOT NULL)"
    for n, (t, c, p, pc) in LINKS.items()))
def fk_audit(t):
    return stacked(k.orphan_audit(t(table), col, t(parent), target, n) for n, (table, col, parent, target) in LINKS.items())


@query("check_audit", """WITH l AS (SELECT COUNT(*) AS n, COUNT(*) FILTER (WHERE NOT (l_quantity > 0)) AS a,
    COUNT(*) FILTER (WHERE NOT (l_discount BETWEEN 0 AND 1)) AS b, COUNT(*) FILTER (WHERE NOT (l_returnflag IN ('A', 'N'))) AS c,
    COUNT(*) FILTER (WHERE NOT (l_shipdate > o_orderdate)) AS d, COUNT(*) FILTER (WHERE NOT (l_extendedprice > 0.6 * p_retailprice * l_quantity)) AS e
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)
  SELECT 'quantity_positive' AS rule, n AS n_rows, a AS violations FROM l UNION ALL SELECT 'discount_range', n, b FROM l
  UNION ALL SELECT 'flag_enum', n, c FROM l UNION ALL SELECT 'ship_after_order', n, d FROM l UNION ALL SELECT 'price_over_cost', n, e FROM l""")
def check_audit(t):
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(
        t("part"), F.col("l_partkey") == F.col("p_partkey")
    )
    return k.rule_audit(rows, {
        "quantity_positive": F.col("l_quantity") > 0,
        "discount_range": F.col("l_discount").between(0, 1),
        "flag_enum": F.col("l_returnflag").isin("A", "N"),
        "ship_after_order": F.col("l_shipdate") > F.col("o_orderdate"),
        "price_over_cost": F.col("l_extendedprice") > b.COST_RATE * F.col("p_retailprice") * F.col("l_quantity"),
    })


@query("headcount_reconcile", f"""WITH {b.SQL_STAFF_DATES}
  SELECT department, COUNT(*) AS stored, COUNT(*) FILTER (WHERE end_date IS NULL) AS active,
    COUNT(*) - COUNT(*) FILTER (WHERE end_date IS NULL) AS difference FROM staffed GROUP BY 1""")
def headcount_reconcile(t):
    staff = b.staff(t, dates=True)
    stored = staff.groupBy("department").agg(F.count(F.lit(1)).alias("stored"))
    active = staff.where("end_date IS NULL").groupBy("department").agg(F.count(F.lit(1)).alias("active"))
    return stored.join(active, "department", "left").withColumn("active", F.coalesce("active", F.lit(0))).withColumn(
        "difference", F.col("stored") - F.col("active")
    )


@query("rowcount_estimate", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, NULLIF(COUNT(*), 0) AS row_estimate FROM {t}" for t in ALL_TABLES))
def rowcount_estimate(t):
    # Parquet keeps row counts in its footers, so counting reads no column. Empty tables count as never analysed.
    never = F.when(F.count(F.lit(1)) == 0, F.lit(-1).cast("long")).otherwise(F.count(F.lit(1)))
    return stacked(
        t(n).agg(never.alias("c")).select(F.lit(n).alias("table_name"), k.known_estimate(F.col("c")).alias("row_estimate"))
        for n in ALL_TABLES
    )


# --- catalogue: a conversation is a table, its turns are the columns ---------
def turn_columns(t):
    name = F.concat(F.lit("t"), F.col("turn").cast("string"))
    return t("conversations").select(
        F.concat(F.lit("conv_"), F.col("conv_id").cast("string")).alias("table_name"), name.alias("column_name"),
        F.col("role").alias("data_type"), (F.col("role") == "system").alias("is_generated"), (F.col("turn") == 0).alias("is_key"),
        F.when(F.col("turn") == 1, F.concat(F.lit("conv_"), (F.col("conv_id") + 1).cast("string"))).alias("reference"),
        "turn", "text",
    )


def part_columns(t):
    """Parts as tables of three columns, whose types are the part's attributes."""
    link = F.concat(F.lit("kind_"), F.col("p_type"))
    none = F.lit(None).cast("string")
    cols = [("brand", F.col("p_brand"), False, True, none), ("kind", F.col("p_type"), False, False, link),
            ("size", F.col("p_size").cast("string"), True, False, none)]
    rows = F.array(*[
        F.struct(F.lit(n).alias("column_name"), v.alias("data_type"), F.lit(g).alias("is_generated"), F.lit(k_).alias("is_key"), r_.alias("reference"))
        for n, v, g, k_, r_ in cols
    ])
    return t("part").select(F.concat(F.lit("part_"), F.col("p_partkey").cast("string")).alias("table_name"), F.inline(rows))


@query("catalogue_hash", """WITH line AS (SELECT p_brand, 'part_' || p_partkey AS table_name, 'part_' || p_partkey || '|brand:' || p_brand || ':False,kind:' || p_type
    || ':False,size:' || p_size || ':True|brand|kind->kind_' || p_type AS line FROM part)
  SELECT p_brand AS database, substring(sha256(string_agg(line, chr(10) ORDER BY table_name)), 1, 16) AS fingerprint FROM line GROUP BY 1""")
def catalogue_hash(t):
    """One hash for all tables of a brand, read as a database."""
    brands = t("part").select(F.concat(F.lit("part_"), F.col("p_partkey").cast("string")).alias("table_name"), F.col("p_brand").alias("database"))
    return k.catalogue_fingerprint(part_columns(t).join(brands, "table_name"), "database")


SQL_LINE = """WITH line AS (SELECT p_brand, p_partkey, p_size, 'part_' || p_partkey AS table_name, 'part_' || p_partkey || '|brand:' || p_brand || ':False,kind:' || p_type
    || ':False,size:{size}:True|brand|kind->kind_' || p_type AS line FROM part)"""


def sql_tree(levels: int = 7) -> str:
    """The hash tree level by level, each from the databases that have more than one node below."""
    parts = [SQL_LINE.format(size="' || p_size || '") + """, l0 AS (SELECT p_brand, ROW_NUMBER() OVER (PARTITION BY p_brand ORDER BY table_name) - 1 AS node,
    substring(sha256(line), 1, 16) AS hash, COUNT(*) OVER (PARTITION BY p_brand) AS n FROM line)"""]
    for k in range(1, levels):
        parts.append(f"""l{k} AS (SELECT p_brand, node // 16 AS node, substring(sha256(string_agg(hash, chr(10) ORDER BY l{k - 1}.node)), 1, 16) AS hash,
    (n + 15) // 16 AS n FROM l{k - 1} WHERE n > 1 GROUP BY p_brand, l{k - 1}.node // 16, n)""")
    every = " UNION ALL ".join(f"SELECT p_brand AS database, hash AS fingerprint, {k}::BIGINT AS depth FROM l{k} WHERE n = 1" for k in range(levels))
    return ", ".join(parts) + " " + every


def brand_leaves(t, changed: bool = False):
    """Fingerprints of the parts as tables of their brand; ``changed`` alters, drops and adds some."""
    brands = t("part").select(F.concat(F.lit("part_"), F.col("p_partkey").cast("string")).alias("table_name"), F.col("p_brand").alias("database"), "p_partkey", "p_size")
    cols = part_columns(t)
    if changed:
        odd = F.substring_index("table_name", "_", -1).cast("long") % 97 == 5
        cols = cols.withColumn("data_type", F.when(odd & (F.col("column_name") == "size"), "text").otherwise(F.col("data_type")))
    lines = k.table_lines(cols).select("table_name", k.fingerprint(F.col("line")).alias("hash")).join(brands, "table_name")
    if changed:
        lost = (F.col("database") == "Brand#11") & (F.col("p_size") == 7)
        lines = lines.where(~lost)
        added = lines.where((F.col("database") == "Brand#12") & (F.col("p_size") == 8)).withColumn("table_name", F.concat("table_name", F.lit("_new")))
        lines = lines.unionByName(added)
    return lines.select("database", "table_name", "hash")


@query("catalogue_tree", sql_tree())
def catalogue_tree(t):
    """One hash for all tables of a brand, read as a database, from a tree of hashes."""
    return hash_tree.roots(hash_tree.build(brand_leaves(t)))


@query("catalogue_drift", SQL_LINE.format(size="' || CASE WHEN p_partkey % 97 = 5 THEN 'text' ELSE p_size::VARCHAR END || '").replace("WITH line", "WITH now") + ", "
    + SQL_LINE.format(size="' || p_size || '").removeprefix("WITH ") + """,
  new AS (SELECT p_brand, table_name, line FROM now WHERE NOT (p_brand = 'Brand#11' AND p_size = 7)
    UNION ALL SELECT p_brand, table_name || '_new', line FROM now WHERE p_brand = 'Brand#12' AND p_size = 8)
  SELECT COALESCE(o.p_brand, n.p_brand) AS database, COALESCE(o.table_name, n.table_name) AS table_name,
    CASE WHEN o.line IS NULL THEN 'added' WHEN n.line IS NULL THEN 'removed' ELSE 'changed' END AS change
  FROM line o FULL JOIN new n ON o.p_brand = n.p_brand AND o.table_name = n.table_name WHERE o.line IS DISTINCT FROM n.line""")
def catalogue_drift(t):
    """Tables that differ between two states of the databases, found from the roots down."""
    return hash_tree.drift(hash_tree.build(brand_leaves(t)), hash_tree.build(brand_leaves(t, changed=True)))[0]


@query("schema_fingerprint", """SELECT 'part_' || p_partkey AS table_name, substring(sha256('part_' || p_partkey || '|brand:' || p_brand || ':False,kind:' || p_type
    || ':False,size:' || p_size || ':True|brand|kind->kind_' || p_type), 1, 16) AS fingerprint FROM part""")
def schema_fingerprint(t):
    return k.table_lines(part_columns(t)).select("table_name", k.fingerprint(F.col("line")).alias("fingerprint"))


@query("schema_diff", """WITH a AS (SELECT conv_id, turn, role FROM conversations), z AS (SELECT conv_id, turn + 1 AS turn, role FROM conversations)
  SELECT 'conv_' || conv_id AS table_name, 't' || turn AS column_name, a.role AS old_type, z.role AS new_type,
    CASE WHEN a.role IS NULL THEN 'added' WHEN z.role IS NULL THEN 'removed' ELSE 'retyped' END AS change
  FROM a FULL JOIN z USING (conv_id, turn) WHERE a.role IS DISTINCT FROM z.role""")
def schema_diff(t):
    old = turn_columns(t)
    new = old.withColumn("column_name", F.concat(F.lit("t"), (F.col("turn") + 1).cast("string")))
    return k.schema_diff(old, new)


def notes(t):
    """Existing notes: one per conversation and turn; user turns count as reviewed."""
    turns = turn_columns(t).select(
        "table_name", "column_name", F.md5("text").alias("text"), F.when(F.col("data_type") == "user", "human").otherwise("model").alias("reviewed_by"),
        "turn", F.length("text").alias("size"),
    )
    tables = turns.where("turn = 0").withColumn("column_name", F.lit(None).cast("string"))
    return turns.unionByName(tables)


def fresh_notes(t):
    """Fresh notes: conversations that start with a long turn, and their longer turns."""
    old = notes(t)
    live = old.where("column_name IS NULL AND size > 80").select("table_name")
    kept = old.where("column_name IS NULL OR size > 60").withColumns({
        "text": F.concat(F.lit("new "), F.col("text")), "reviewed_by": F.lit("model")
    })
    return kept.join(live, "table_name", "left_semi")


SQL_NOTES = """WITH t AS (SELECT 'conv_' || conv_id AS table_name, 't' || turn AS column_name, md5(text) AS text,
    CASE WHEN role = 'user' THEN 'human' ELSE 'model' END AS reviewed_by, turn, length(text) AS size FROM conversations),
  old AS (SELECT * FROM t UNION ALL SELECT * REPLACE (CAST(NULL AS VARCHAR) AS column_name) FROM t WHERE turn = 0),
  fresh AS (SELECT table_name, column_name, 'new ' || text AS text, 'model' AS reviewed_by FROM old
    WHERE (column_name IS NULL OR size > 60) AND table_name IN (SELECT table_name FROM old WHERE column_name IS NULL AND size > 80)),
  j AS (SELECT COALESCE(o.table_name, f.table_name) AS table_name, COALESCE(o.column_name, f.column_name) AS column_name,
    o.text AS ot, o.reviewed_by AS orb, f.text AS ft, f.reviewed_by AS frb FROM old o FULL JOIN fresh f
      ON o.table_name = f.table_name AND o.column_name IS NOT DISTINCT FROM f.column_name),
  merged AS (SELECT table_name, column_name, CASE WHEN orb = 'human' THEN ot ELSE ft END AS text,
    CASE WHEN orb = 'human' THEN orb ELSE frb END AS reviewed_by, CASE WHEN orb = 'human' THEN 'existing' ELSE 'fresh' END AS origin
    FROM j WHERE table_name IN (SELECT table_name FROM fresh) AND (frb IS NOT NULL OR (column_name IS NOT NULL AND orb = 'human')))"""


@query("priority_merge", SQL_NOTES + " SELECT * FROM merged")
def priority_merge(t):
    return k.merge_entries(notes(t), fresh_notes(t))


@query("merge_guard", SQL_NOTES + """, h AS (SELECT o.*, EXISTS (SELECT 1 FROM merged m WHERE m.table_name = o.table_name
    AND m.column_name IS NOT DISTINCT FROM o.column_name) AS kept FROM old o WHERE reviewed_by = 'human')
  SELECT COUNT(*) AS reviewed, COUNT(*) FILTER (WHERE NOT kept) AS lost, COUNT(*) FILTER (WHERE NOT kept) > COUNT(*) * 0.5 AS refuse FROM h""")
def merge_guard(t):
    old = notes(t)
    return k.merge_guard(old, k.merge_entries(old, fresh_notes(t)))


def label_notes(t):
    return t("labels").select(
        "doc_id", F.when(F.col("quality") == 1, "human").otherwise("model").alias("reviewed_by"),
        F.when(F.col("toxic") == 1, "low").otherwise("high").alias("confidence"),
    )


SQL_REVIEW = """WITH rv AS (SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN '' WHEN quality = 1 THEN 'human' ELSE 'model' END AS reviewed_by,
    CASE WHEN l.doc_id IS NULL OR toxic = 1 THEN 'low' ELSE 'high' END AS confidence FROM documents d LEFT JOIN labels l USING (doc_id))"""


@query("review_queue", SQL_REVIEW + " SELECT * FROM rv WHERE reviewed_by <> 'human' AND confidence = 'low'")
def review_queue(t):
    return k.review_queue(k.review_rows(t("documents"), label_notes(t), ["doc_id"]))


@query("review_progress", SQL_REVIEW + f""" SELECT COUNT(*) FILTER (WHERE reviewed_by <> 'human' AND confidence = 'low') AS queued,
    COUNT(*) FILTER (WHERE reviewed_by <> 'human' AND confidence = 'high') AS hidden_confident,
    COUNT(*) FILTER (WHERE reviewed_by = 'human') AS reviewed, COUNT(*) AS entries,
    {q("COUNT(*) FILTER (WHERE reviewed_by = 'human')", 'COUNT(*)')} AS progress FROM rv""")
def review_progress(t):
    return k.review_progress(k.review_rows(t("documents"), label_notes(t), ["doc_id"]))


SQL_TOKENS = "list_distinct(regexp_extract_all(strip_accents(replace(lower({0}), 'đ', 'd')), '[a-z0-9]+'))"


@query("opaque_names", f"""WITH n AS (SELECT DISTINCT UNNEST({SQL_TOKENS.format('text')}) AS name FROM documents),
    l AS (SELECT name, regexp_replace(name, '[^a-z]', '', 'g') AS letters FROM n)
  SELECT name, regexp_full_match(name, '[a-z]{{1,3}}[0-9]+') OR length(letters) = 1
    OR (length(letters) >= 2 AND NOT regexp_matches(letters, '[aeiouy]')) AS is_opaque FROM l""")
def opaque_names(t):
    names = t.spread("documents", "doc_id").select(F.explode(tokens(F.col("text"))).alias("name")).distinct()
    return names.withColumn("is_opaque", k.is_opaque(F.col("name")))


@query("foreign_script", """
  SELECT doc_id, CASE WHEN regexp_matches(text, '[぀-ヿ㐀-䶿一-鿿가-힣]') OR NOT regexp_matches(lang, '[aeiouy]') THEN 'low' WHEN quality = 1 THEN 'high' ELSE 'low' END AS confidence
  FROM documents LEFT JOIN labels USING (doc_id)""")
def foreign_script(t):
    level = F.when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "medium")
    joined = t("documents").select("doc_id", "lang", "text").join(t("labels"), "doc_id", "left")
    return joined.select("doc_id", k.settled_confidence(F.col("lang"), F.col("text"), level).alias("confidence"))


@query("catalogue_size", f"""WITH s AS (SELECT source, COUNT(*) AS n FROM documents GROUP BY 1),
    a AS (SELECT source, COUNT(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1)
  SELECT COUNT(*) AS n_databases, SUM(a.n)::BIGINT AS n_questions, {q('SUM(s.n)', 'COUNT(*)')} AS mean_tables, MAX(s.n) AS max_tables
  FROM a JOIN s USING (source)""")
def catalogue_size(t):
    docs = t("documents").select("doc_id", "source")
    return k.catalogue_size(docs, t("labels").join(docs, "doc_id"), "source")


@query("fk_target_unique", """WITH c AS (SELECT conv_id, turn, role FROM conversations),
  l AS (SELECT 'conv_' || conv_id AS child_table, 't' || turn AS child_column, 'CONV_' || (conv_id + 1) AS parent_table,
    CASE WHEN role = 'user' THEN 'T0' ELSE 't' || turn END AS parent_column, conv_id + 1 AS pid,
    CASE WHEN role = 'user' THEN 0 ELSE turn END AS pt FROM c WHERE turn > 0)
  SELECT child_table, child_column, parent_table, parent_column, 't' || c.turn AS target_column,
    c.turn IS NOT NULL AND c.turn = 0 AS kept,
    CASE WHEN pid NOT IN (SELECT conv_id FROM c) THEN 'no such table' WHEN c.turn IS NULL THEN 'no such column'
      WHEN c.turn <> 0 THEN 'target not unique' END AS reason
  FROM l LEFT JOIN c ON pid = c.conv_id AND pt = c.turn""")
def fk_target_unique(t):
    cols = turn_columns(t)
    links = t("conversations").where("turn > 0").select(
        F.concat(F.lit("conv_"), F.col("conv_id")).alias("child_table"), F.concat(F.lit("t"), F.col("turn")).alias("child_column"),
        F.concat(F.lit("CONV_"), F.col("conv_id") + 1).alias("parent_table"),
        F.when(F.col("role") == "user", "T0").otherwise(F.concat(F.lit("t"), F.col("turn"))).alias("parent_column"),
    )
    return k.fk_targets(links, cols, cols.where("is_key"))
