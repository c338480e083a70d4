"""Tool-call linking for chat logs, in SQL functions only.

Calls and results are hash-joined by identifier (the side with one row for each identifier is hashed within its
partition); calls are put in topological order by the longest chain of
dependencies below them; arguments are validated against schemas; and everything is serialised as canonical JSON
(keys sorted, no blanks), which a VARIANT's objects are by construction.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common


@dataclass(frozen=True)
class Field:
    name: str
    type: str  # string, bigint, double or boolean
    required: bool = True
    least: int | None = None  # of a number, or of a string's length
    most: int | None = None


def canonical(value: Column) -> Column:
    """Canonical JSON of a struct, array or map; null fields are left out."""
    return F.to_json(F.parse_json(F.to_json(value)))


def problems(arguments: Column, fields: tuple[Field, ...]) -> Column:
    """What is wrong with the arguments (a JSON string) under a schema, as an array."""
    kinds = {"string": ["STRING"], "bigint": ["BIGINT"], "double": ["BIGINT", "DOUBLE", "DECIMAL"], "boolean": ["BOOLEAN"]}
    value, out = F.try_parse_json(arguments), []
    for f in fields:
        at, path = F.try_variant_get(value, f"$.{f.name}", f.type), F.try_variant_get(value, f"$.{f.name}", "variant")
        missing = path.isNull() | F.is_variant_null(path)
        kind = F.regexp_extract(F.schema_of_variant(path), r"^\w+", 0)
        size = F.length(at) if f.type == "string" else at
        out.append(F.when(missing, F.lit(f"missing {f.name}") if f.required else None).when(~kind.isin(kinds[f.type]), f"type of {f.name}"))
        for bound, bad in ((f.least, lambda x, b: x < b), (f.most, lambda x, b: x > b)):
            if bound is not None:
                out.append(F.when(~missing & kind.isin(kinds[f.type]) & bad(size, bound), f"range of {f.name}"))
    return F.when(value.isNull(), F.array(F.lit("not JSON"))).otherwise(F.array_compact(F.array(*out)))


def validated(calls: DataFrame, schemas: dict[str, tuple[Field, ...]]) -> DataFrame:
    """``calls`` with ``errors``: those under the schema of ``name``; an unknown name is an error."""
    errors = F.array(F.lit("unknown tool"))
    for name, fields in schemas.items():
        errors = F.when(F.col("name") == name, problems(F.col("arguments"), fields)).otherwise(errors)
    return calls.withColumn("errors", errors)


def hashed(side: DataFrame) -> DataFrame:
    """The build side of a hash join by identifier: it has one row for each identifier, so no hot one can swell its table."""
    return side.hint("shuffle_hash")


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(call_id, level): calls on the longest chain of dependencies below each; null in or above a cycle.

    ``edges`` are (call_id, needs), both among ``nodes``. Where every call needs one other at most, distances are doubled each
    round, so rounds grow with the logarithm of the longest chain; else calls whose needs are all placed are
    peeled off, level by level. Each round is a table in the shared folder.
    """
    spark = nodes.sparkSession
    edges, _ = common.materialise(edges.distinct(), "chat-edges")
    many = edges.groupBy("call_id").count().where("count > 1").limit(1).count()
    if not many:
        state, at = common.materialise(nodes.select("call_id").distinct().join(hashed(edges), "call_id", "left").select("call_id", F.col("needs").alias("to"), F.col("needs").isNotNull().cast("long").alias("level")), "chat-levels")
        rounds, n = 0, state.count()
        while state.where("to IS NOT NULL").limit(1).count() and 1 << rounds <= n:
            over = state.select(F.col("call_id").alias("to"), F.col("to").alias("beyond"), F.col("level").alias("more"))
            state, new = common.materialise(state.join(hashed(over), "to", "left").select("call_id", F.col("beyond").alias("to"), (F.col("level") + F.coalesce("more", F.lit(0))).alias("level")), "chat-levels")
            common.discard(spark, at)
            rounds, at = rounds + 1, new
        return state.select("call_id", F.when(F.col("to").isNull(), F.col("level")).alias("level"))
    left, _ = common.materialise(nodes.select("call_id").distinct(), "chat-left")
    placed, depth = None, 0
    while True:
        open_needs = edges.join(left.withColumnRenamed("call_id", "needs"), "needs", "left_semi")
        ready, _ = common.materialise(left.join(open_needs, "call_id", "left_anti").withColumn("level", F.lit(depth).cast("long")), "chat-ready")
        if not ready.limit(1).count():
            stuck = left.withColumn("level", F.lit(None).cast("long"))
            return stuck if placed is None else placed.unionByName(stuck)
        placed = ready if placed is None else placed.unionByName(ready)
        left, _ = common.materialise(left.join(ready, "call_id", "left_anti"), "chat-left")
        depth += 1


def linked(calls: DataFrame, results: DataFrame, schemas: dict[str, tuple[Field, ...]]) -> tuple[DataFrame, DataFrame]:
    """Calls and results, each joined with the other side by call_id.

    Calls (call_id, name, arguments, needs array<string>, and any more columns) gain ``status`` (linked; missing: no
    result; ambiguous: several results, or calls of one id), ``level``, ``errors`` and ``canonical``; a need that is no call is
    dropped from the order and reported in ``errors``. Results (call_id, content, and more) gain ``status`` (linked, ambiguous, or
    orphan: no such call) and ``canonical``. Null ids link with nothing.
    """
    calls = calls.withColumn("needs", F.coalesce("needs", F.array().cast("array<string>")))
    known = calls.where("call_id IS NOT NULL").groupBy("call_id").agg(F.count("*").alias("_calls"))
    given = results.where("call_id IS NOT NULL").groupBy("call_id").agg(F.count("*").alias("_results"))
    wanted = calls.where("call_id IS NOT NULL").select("call_id", F.explode("needs").alias("needs"))
    needed = hashed(known.select(F.col("call_id").alias("needs")))
    edges = wanted.join(needed, "needs", "left_semi").select("call_id", "needs")
    dangling = wanted.join(needed, "needs", "left_anti").groupBy("call_id").agg(F.sort_array(F.collect_set(F.concat(F.lit("no call "), "needs"))).alias("_dangling"))
    joined = validated(calls, schemas)
    for side in (known, given, dangling, levels(known, edges)):
        joined = joined.join(hashed(side), "call_id", "left")
    status = F.when(F.coalesce("_results", F.lit(0)) == 0, "missing").when((F.col("_results") > 1) | (F.col("_calls") > 1), "ambiguous").otherwise("linked")
    shown = canonical(F.struct(F.coalesce(F.try_parse_json("arguments"), F.parse_json(F.lit("null"))).alias("arguments"), F.col("call_id").alias("id"), "name", "needs"))
    out = joined.withColumns({"status": status, "errors": F.concat("errors", F.coalesce("_dangling", F.array().cast("array<string>"))), "canonical": shown}).drop("_calls", "_results", "_dangling")
    met = results.join(hashed(known), "call_id", "left").join(hashed(given), "call_id", "left")
    status = F.when(F.coalesce("_calls", F.lit(0)) == 0, "orphan").when((F.col("_results") > 1) | (F.col("_calls") > 1), "ambiguous").otherwise("linked")
    return out, met.withColumns({"status": status, "canonical": canonical(F.struct("call_id", "content"))}).drop("_calls", "_results")


#: The tool behind the conversations' user turns.
ASK = {"ask": (Field("prompt", "string", True, 1, 4000), Field("words", "bigint", True, 1), Field("reply_to", "string", False))}


def formatted(turns: DataFrame) -> DataFrame:
    """A conversation log (conv_id, turn, role, text) as linked tool calls.

    A user turn is a call of ``ask``, which needs the calls one or two turns before it; an assistant turn is the result of
    the call one turn before; any other turn is a plain message. Null texts are empty arguments or contents, null
    roles are messages, very long texts are kept whole (and break the schema's limit), null conversation or turn numbers count as empty strings in identifiers. Repeated turns make
    their calls ambiguous and stay; an empty table gives no rows; other columns are ignored.
    """
    ident = lambda back: F.concat_ws(":", F.lit("call"), F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.coalesce((F.col("turn") - back).cast("string"), F.lit("")))
    log = turns.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    before = log.where("role = 'user'").select(ident(0).alias("before")).distinct()
    calls = log.where("role = 'user'").select("conv_id", "turn", "text", ident(0).alias("call_id"), ident(1).alias("one"), ident(2).alias("two"))
    has = [before.select(F.col("before").alias(c), F.lit(True).alias(f"has_{c}")) for c in ("one", "two")]
    calls = calls.join(hashed(has[0]), "one", "left").join(hashed(has[1]), "two", "left")
    first = F.when(F.col("has_one"), F.col("one")).when(F.col("has_two"), F.col("two"))
    words = F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    calls = calls.select("conv_id", "turn", "call_id", F.lit("ask").alias("name"), F.to_json(F.struct(F.col("text").alias("prompt"), first.alias("reply_to"), words.alias("words"))).alias("arguments"), F.array_compact(F.array(first)).alias("needs"))
    results = log.where("role = 'assistant'").select("conv_id", "turn", ident(1).alias("call_id"), F.col("text").alias("content"))
    asked, given = linked(calls, results, ASK)
    out = ["conv_id", "turn", "kind", "call_id", "status", "level", "errors", "canonical"]
    rest = log.where("role IS NULL OR role NOT IN ('user', 'assistant')").withColumns({"kind": F.lit("message"), "call_id": F.lit(None).cast("string"), "status": F.lit("plain"), "canonical": canonical(F.struct(F.col("text").alias("content"), "role"))})
    parts = [asked.withColumns({"kind": F.lit("call"), "errors": F.array_join("errors", "; ")}), *(d.withColumns({"kind": F.lit(k) if k else F.col("kind"), "level": F.lit(None).cast("long"), "errors": F.lit("")}) for d, k in ((given, "result"), (rest, None)))]
    return parts[0].select(out).unionByName(parts[1].select(out)).unionByName(parts[2].select(out))


def op4_chat(spark, sf_dir: str) -> DataFrame:
    return formatted(common.table(spark, sf_dir, "conversations"))


ORACLE = r"""
WITH RECURSIVE t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, 'call:' || coalesce(CAST(conv_id AS VARCHAR), '') || ':' AS pre FROM conversations),
u AS (SELECT *, pre || turn AS id FROM t WHERE role = 'user'),
d AS (SELECT u.*, CASE WHEN a.id IS NOT NULL THEN a.id ELSE b.id END AS need
      FROM u LEFT JOIN (SELECT DISTINCT id FROM u) a ON a.id = u.pre || (u.turn - 1) LEFT JOIN (SELECT DISTINCT id FROM u) b ON b.id = u.pre || (u.turn - 2)),
lv AS (SELECT id, 0 AS level FROM d WHERE need IS NULL UNION SELECT d.id, lv.level + 1 FROM d JOIN lv ON d.need = lv.id),
r AS (SELECT *, pre || (turn - 1) AS id FROM t WHERE role = 'assistant'),
nc AS (SELECT id, count(*) AS n FROM u GROUP BY id), nr AS (SELECT id, count(*) AS n FROM r GROUP BY id),
w AS (SELECT *, len(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS words FROM d)
SELECT conv_id, turn, 'call' AS kind, id AS call_id,
       CASE WHEN coalesce(nr.n, 0) = 0 THEN 'missing' WHEN nr.n > 1 OR nc.n > 1 THEN 'ambiguous' ELSE 'linked' END AS status, CAST(level AS BIGINT) AS level,
       concat_ws('; ', CASE WHEN length(text) < 1 OR length(text) > 4000 THEN 'range of prompt' END, CASE WHEN words < 1 THEN 'range of words' END) AS errors,
       '{"arguments":{"prompt":' || CAST(to_json(text) AS VARCHAR) || CASE WHEN need IS NULL THEN '' ELSE ',"reply_to":' || CAST(to_json(need) AS VARCHAR) END || ',"words":' || words || '},"id":' || CAST(to_json(id) AS VARCHAR) || ',"name":"ask","needs":[' || CASE WHEN need IS NULL THEN '' ELSE CAST(to_json(need) AS VARCHAR) END || ']}' AS canonical
FROM w LEFT JOIN nc USING (id) LEFT JOIN nr USING (id) LEFT JOIN lv USING (id)
UNION ALL
SELECT conv_id, turn, 'result', id, CASE WHEN coalesce(nc.n, 0) = 0 THEN 'orphan' WHEN nr.n > 1 OR nc.n > 1 THEN 'ambiguous' ELSE 'linked' END, NULL, '',
       '{"call_id":' || CAST(to_json(id) AS VARCHAR) || ',"content":' || CAST(to_json(text) AS VARCHAR) || '}'
FROM r LEFT JOIN nc USING (id) LEFT JOIN nr USING (id)
UNION ALL
SELECT conv_id, turn, 'message', NULL, 'plain', NULL, '', '{"content":' || CAST(to_json(text) AS VARCHAR) || CASE WHEN role IS NULL THEN '' ELSE ',"role":' || CAST(to_json(role) AS VARCHAR) END || '}'
FROM t WHERE role IS NULL OR role NOT IN ('user', 'assistant')
"""
