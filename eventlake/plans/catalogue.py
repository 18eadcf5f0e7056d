"""Queries over the log operators, and the SQL that each is held against."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.identifiers import chunk_key, chunk_start, java_shard, uuid_start_of, uuid_timestamp, uuid_v5
from ..functions.text import base64_bytes, base64_line, decode_strict, encode_strict, full_match
from ..operators import fold, log, runs, visibility
from ..sources import chunks, control, csv_codec, framing, json_codec, xml_events, xsd
from ..streaming import roles
from ..tables import new_path, read_table
from . import more  # noqa: F401
from .registry import NAMESPACE, QUERIES, SQL, query  # noqa: F401
from .registry import entity_log as _log

# Reading the log


@query("WITH {LOG} SELECT persistence_id, sequence_nr, timestamp_ms, event FROM log WHERE tag = 'purchase' AND timestamp_ms >= epoch_ms(TIMESTAMP '2024-01-15')")
def events_by_tag_since(spark, sf_dir):
    return log.events_by_tag(_log(spark, sf_dir), "purchase", "2024-01-15T00:00:00Z").select("persistence_id", "sequence_nr", "timestamp_ms", "event")


@query("WITH {LOG} SELECT sequence_nr, timestamp_ms, tag, event FROM log WHERE persistence_id = '7'")
def events_by_key(spark, sf_dir):
    return log.events_by_key(_log(spark, sf_dir), "7").select("sequence_nr", "timestamp_ms", "tag", "event")


@query("WITH {LOG} SELECT * FROM log WHERE timestamp_ms >= epoch_ms(TIMESTAMP '2024-01-05') AND timestamp_ms < epoch_ms(TIMESTAMP '2024-01-12') AND tag = 'click'")
def take_while_slice(spark, sf_dir):
    return log.events_by_tag(_log(spark, sf_dir), "click", "2024-01-05T00:00:00Z", "2024-01-12T00:00:00Z")


@query("""WITH {LOG}, keys AS (SELECT DISTINCT persistence_id FROM log WHERE tag = 'error' AND value > 90)
SELECT persistence_id, sequence_nr, timestamp_ms FROM log WHERE persistence_id IN (SELECT persistence_id FROM keys) AND timestamp_ms < epoch_ms(TIMESTAMP '2024-01-20')""")
def selective_reimport(spark, sf_dir):
    events = _log(spark, sf_dir)
    keys = events.where("tag = 'error' and value > 90").select("persistence_id").distinct()
    return log.events_of_keys(events, keys, 1_705_708_800_000).select("persistence_id", "sequence_nr", "timestamp_ms")


@query("WITH {LOG} SELECT persistence_id, sequence_nr, timestamp_ms, tag FROM log")
def dedupe_replay(spark, sf_dir):
    events = _log(spark, sf_dir).select("persistence_id", "sequence_nr", "timestamp_ms", "tag")
    return log.deduplicated(events.union(events.where("timestamp_ms >= 1704844800000")))


@query("""WITH {LOG}, kept AS (SELECT * FROM log WHERE event_id % 17 <> 0),
numbered AS (SELECT *, row_number() OVER (PARTITION BY persistence_id ORDER BY sequence_nr) AS n FROM kept)
SELECT persistence_id, max(sequence_nr) AS last_nr FROM numbered WHERE sequence_nr = n GROUP BY ALL""")
def contiguous_prefix(spark, sf_dir):
    kept = log.contiguous_prefix(_log(spark, sf_dir).where("event_id % 17 <> 0"))
    return kept.groupBy("persistence_id").agg(F.max("sequence_nr").alias("last_nr"))


# Folds


@query("WITH {LOG} SELECT persistence_id, max(sequence_nr) AS sequence_nr, arg_max(tag, sequence_nr) AS tag, arg_max(event, sequence_nr) AS event FROM log GROUP BY 1")
def entity_latest_state(spark, sf_dir):
    return fold.latest_state(_log(spark, sf_dir), ["tag", "event"])


@query("""WITH {LOG} SELECT persistence_id, CAST(count(*) AS BIGINT) AS n, arg_max(tag, sequence_nr) AS last_tag,
CAST(sum(CAST(floor(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM log GROUP BY 1""")
def entity_fold_total(spark, sf_dir):
    whole = _log(spark, sf_dir).groupBy("persistence_id")
    return whole.agg(F.count("*").alias("n"), F.max_by("tag", "sequence_nr").alias("last_tag"), F.sum(F.floor(F.col("value") * 100)).alias("cents"))


@query("""WITH {LOG}, halves AS (SELECT max(CASE WHEN tag = 'purchase' THEN timestamp_ms END) AS a, max(CASE WHEN tag = 'error' THEN timestamp_ms END) AS b, persistence_id FROM log GROUP BY persistence_id)
SELECT persistence_id, COALESCE(least(nullif(a, 0), nullif(b, 0)), 0) AS progress FROM halves""")
def combined_offset(spark, sf_dir):
    last = lambda t: F.max(F.when(F.col("tag") == t, F.col("timestamp_ms")))
    both = _log(spark, sf_dir).groupBy("persistence_id").agg(last("purchase").alias("a"), last("error").alias("b"))
    return both.select("persistence_id", fold.combined_offset(F.col("a"), F.col("b")).alias("progress"))


@query("WITH {LOG} SELECT timestamp_ms // 3600000 AS period, max(timestamp_ms) AS last, min(timestamp_ms) AS first FROM log GROUP BY 1")
def conflated_progress(spark, sf_dir):
    return fold.conflated(_log(spark, sf_dir), F.floor(F.col("timestamp_ms") / 3_600_000), "timestamp_ms")


ACL_SQL = """changes AS (SELECT CAST(floor(value) AS BIGINT) % 3 AS "right", persistence_id AS target, tag <> 'error' AS granted, timestamp_ms * 1000000 + event_id % 1000000 AS ord
FROM log WHERE tag IN ('signup', 'purchase', 'error')),
acl AS (SELECT "right", target FROM changes GROUP BY ALL HAVING arg_max(granted, ord))"""


def _acl(spark, sf_dir):
    events = _log(spark, sf_dir).where("tag in ('signup', 'purchase', 'error')")
    changes = events.select((F.floor("value") % 3).alias("right"), F.col("persistence_id").alias("target"), (F.col("tag") != "error").alias("granted"), (F.col("timestamp_ms") * 1_000_000 + F.col("event_id") % 1_000_000).alias("order"))
    return fold.acl(changes)


@query("WITH {LOG}, " + ACL_SQL + ' SELECT "right", target FROM acl')
def acl_state(spark, sf_dir):
    return _acl(spark, sf_dir)


@query("WITH {LOG}, changes AS (SELECT CAST(floor(value * 50) AS BIGINT) AS \"right\", persistence_id AS target, tag <> 'error' AS granted, timestamp_ms * 1000000 + event_id % 1000000 AS ord FROM log), "
       'acl AS (SELECT "right", target FROM changes GROUP BY ALL HAVING arg_max(granted, ord)) SELECT "right", min(target) AS target FROM acl GROUP BY 1 HAVING count(DISTINCT target) = 1')
def acl_sole_owner(spark, sf_dir):
    changes = _log(spark, sf_dir).select(F.floor(F.col("value") * 50).alias("right"), F.col("persistence_id").alias("target"), (F.col("tag") != "error").alias("granted"), (F.col("timestamp_ms") * 1_000_000 + F.col("event_id") % 1_000_000).alias("order"))
    return fold.sole_owners(fold.acl(changes))


@query("WITH {LOG}, " + ACL_SQL + """, users AS (SELECT DISTINCT persistence_id AS "user", CAST(CAST(persistence_id AS BIGINT) % 10 AS VARCHAR) AS grp FROM log)
SELECT DISTINCT "user", "right" FROM users JOIN acl ON target = "user" OR target = grp""")
def group_rights(spark, sf_dir):
    users = _log(spark, sf_dir).select(F.col("persistence_id").alias("user")).distinct()
    users = users.withColumn("groups", F.array((F.col("user").cast("bigint") % 10).cast("string")))
    return fold.is_granted(_acl(spark, sf_dir), users)


@query("""WITH RECURSIVE {LOG}, r AS (SELECT persistence_id, timestamp_ms AS t, row_number() OVER (PARTITION BY persistence_id ORDER BY timestamp_ms) AS n FROM log),
b AS (
  SELECT persistence_id, n, t, t AS mark, CAST(2 AS BIGINT) AS filled FROM r WHERE n = 1
  UNION ALL
  SELECT r.persistence_id, r.n, r.t, b.mark + ((r.t - b.mark) // 21600000) * 21600000, least(2, greatest(b.filled - 1, 0) + (r.t - b.mark) // 21600000)
  FROM b JOIN r ON r.persistence_id = b.persistence_id AND r.n = b.n + 1)
SELECT persistence_id, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE filled > 0) AS BIGINT) AS granted FROM b GROUP BY 1""")
def throttle_tokens(spark, sf_dir):
    passed = fold.throttle(_log(spark, sf_dir), "persistence_id", "timestamp_ms", 1, 6 * 3_600_000, 2)
    return passed.groupBy("persistence_id").agg(F.count("*").alias("n"), F.count_if("granted").alias("granted"))


# Runs, chunks, slices

RUNS_SQL = """marked AS (SELECT *, CASE WHEN tag = lag(tag) OVER w THEN 0 ELSE 1 END AS opens FROM log WINDOW w AS (PARTITION BY persistence_id ORDER BY sequence_nr)),
numbered AS (SELECT *, CAST(sum(opens) OVER (PARTITION BY persistence_id ORDER BY sequence_nr) AS BIGINT) AS run FROM marked)"""


def _runs(spark, sf_dir):
    return runs.group_while(_log(spark, sf_dir), ["persistence_id"], ["sequence_nr"], F.col("tag") == F.col("prev.tag"))


@query("WITH {LOG}, " + RUNS_SQL + " SELECT persistence_id, run, min(tag) AS tag, CAST(count(*) AS BIGINT) AS n, min(sequence_nr) AS first_nr FROM numbered GROUP BY 1, 2")
def group_while_runs(spark, sf_dir):
    return _runs(spark, sf_dir).groupBy("persistence_id", "run").agg(F.min("tag").alias("tag"), F.count("*").alias("n"), F.min("sequence_nr").alias("first_nr"))


@query("WITH {LOG}, " + RUNS_SQL + " SELECT persistence_id, run, CAST(count(*) AS BIGINT) AS n, count(*) > 3 AS overflow FROM numbered GROUP BY 1, 2")
def group_while_overflow(spark, sf_dir):
    return runs.limited_runs(_runs(spark, sf_dir), ["persistence_id"], 3, strict=False)


@query("""WITH {LOG}, marked AS (SELECT *, CASE WHEN timestamp_ms - lag(timestamp_ms) OVER w <= 21600000 THEN 0 ELSE 1 END AS opens FROM log WINDOW w AS (PARTITION BY persistence_id ORDER BY timestamp_ms, sequence_nr)),
numbered AS (SELECT *, CAST(sum(opens) OVER (PARTITION BY persistence_id ORDER BY timestamp_ms, sequence_nr) AS BIGINT) AS session FROM marked)
SELECT persistence_id, session, CAST(count(*) AS BIGINT) AS n, min(timestamp_ms) AS start_ms, max(timestamp_ms) AS end_ms FROM numbered GROUP BY 1, 2""")
def idle_sessions(spark, sf_dir):
    found = runs.idle_sessions(_log(spark, sf_dir), ["persistence_id"], "timestamp_ms", 6 * 3_600_000, "sequence_nr")
    return found.groupBy("persistence_id", "session").agg(F.count("*").alias("n"), F.min("timestamp_ms").alias("start_ms"), F.max("timestamp_ms").alias("end_ms"))


@query("""WITH {LOG}, n AS (SELECT *, (row_number() OVER (ORDER BY timestamp_ms, event_id) - 1) // 256 AS chunk FROM log)
SELECT chunk, CAST(count(*) AS BIGINT) AS n, min(timestamp_ms) AS first_ms FROM n GROUP BY 1""")
def chunk_by_count(spark, sf_dir):
    found = runs.chunk_by_count(_log(spark, sf_dir), ["timestamp_ms", "event_id"], 256)
    return found.groupBy("chunk").agg(F.count("*").alias("n"), F.min("timestamp_ms").alias("first_ms"))


@query("""WITH {LOG}, g AS (SELECT timestamp_ms // 60000 AS minute, count(*) AS weight FROM log GROUP BY 1),
n AS (SELECT *, CAST((sum(weight) OVER (ORDER BY minute) - 1) // 256 AS BIGINT) AS chunk FROM g)
SELECT chunk, min(minute) AS first_minute, CAST(sum(weight) AS BIGINT) AS n FROM n GROUP BY 1""")
def chunk_by_weight(spark, sf_dir):
    groups = _log(spark, sf_dir).groupBy(F.floor(F.col("timestamp_ms") / 60_000).alias("minute")).agg(F.count("*").alias("weight"))
    found = runs.chunk_by_weight(groups, ["minute"], F.col("weight"), 256)
    return found.groupBy("chunk").agg(F.min("minute").alias("first_minute"), F.sum("weight").alias("n"))


@query("""WITH {LOG}, f AS (SELECT persistence_id, min(sequence_nr) FILTER (WHERE value > 150) AS first_nr FROM log GROUP BY 1)
SELECT persistence_id, sequence_nr FROM log JOIN f USING (persistence_id) WHERE sequence_nr >= first_nr - 1""")
def drop_until_next(spark, sf_dir):
    return runs.drop_until_next(_log(spark, sf_dir), ["persistence_id"], "sequence_nr", F.col("value") > 150).select("persistence_id", "sequence_nr")


@query("WITH {LOG} SELECT persistence_id, max(sequence_nr) AS sequence_nr FROM log GROUP BY 1")
def drop_until_next_nomatch(spark, sf_dir):
    return runs.drop_until_next(_log(spark, sf_dir), ["persistence_id"], "sequence_nr", F.col("value") < -1e9, keep_last=True).select("persistence_id", "sequence_nr")


@query("WITH {LOG} SELECT event_id, CASE WHEN tag = 'purchase' THEN upper(tag) ELSE tag END AS tag, CASE WHEN tag = 'purchase' THEN value * 2 ELSE value END AS value FROM log")
def route_selected(spark, sf_dir):
    found = runs.route_selected(_log(spark, sf_dir), F.col("tag") == "purchase", {"value": F.col("value") * 2, "tag": F.upper("tag")})
    return found.select("event_id", "tag", "value")


@query("""WITH {LOG}, s AS (SELECT tag, timestamp_ms // 86400000 * 86400000 AS start FROM log GROUP BY ALL)
SELECT tag, start, lead(start) OVER (PARTITION BY tag ORDER BY start) AS "end" FROM s""")
def slice_neighbours(spark, sf_dir):
    starts = _log(spark, sf_dir).select("tag", (F.floor(F.col("timestamp_ms") / 86_400_000) * 86_400_000).alias("start")).distinct()
    return runs.neighbours(starts, ["tag"], "start")


# Visibility and replication

VISIBLE_SQL = """sited AS (SELECT *, CASE WHEN tag = 'signup' THEN ['eu', '*'] WHEN tag = 'purchase' THEN ['eu'] WHEN tag = 'error' THEN ['us'] ELSE [] END AS named FROM log),
vis AS (SELECT persistence_id, list_contains(list_distinct(flatten(list(named))), 'us') OR list_contains(list_distinct(flatten(list(named))), '*') AS us,
        COALESCE(arg_min(named[1], sequence_nr) FILTER (WHERE len(named) > 0) = 'eu', false) AS master FROM sited GROUP BY 1)"""


def _visibility(spark, sf_dir, until: int | None = None):
    events = _log(spark, sf_dir)
    events = events if until is None else events.where(F.col("sequence_nr") <= until)
    sites = F.when(F.col("tag") == "signup", F.array(F.lit("eu"), F.lit("*"))).when(F.col("tag") == "purchase", F.array(F.lit("eu"))).when(F.col("tag") == "error", F.array(F.lit("us")))
    return visibility.classify(events, F.coalesce(sites, F.array().cast("array<string>")), "eu")


@query("WITH {LOG}, " + VISIBLE_SQL + " SELECT persistence_id, sequence_nr FROM log SEMI JOIN (SELECT * FROM vis WHERE us) v USING (persistence_id)")
def visible_events(spark, sf_dir):
    return visibility.visible_to(_log(spark, sf_dir), _visibility(spark, sf_dir), "us").select("persistence_id", "sequence_nr")


@query("WITH {LOG}, early AS (SELECT * FROM log WHERE sequence_nr <= 2), sited AS (SELECT *, CASE WHEN tag = 'signup' THEN ['*', 'eu'] WHEN tag = 'purchase' THEN ['eu'] WHEN tag = 'error' THEN ['us'] ELSE [] END AS named FROM early) "
       "SELECT l.persistence_id, l.sequence_nr, COALESCE(v.n, 0) AS n_sites FROM log l LEFT JOIN (SELECT persistence_id, len(list_distinct(flatten(list(named)))) AS n FROM sited GROUP BY 1) v USING (persistence_id)")
def visibility_default(spark, sf_dir):
    found = visibility.with_visibility(_log(spark, sf_dir), _visibility(spark, sf_dir, 2))
    return found.select("persistence_id", "sequence_nr", F.size("sites").cast("bigint").alias("n_sites"))


@query("WITH {LOG}, " + VISIBLE_SQL + """, early AS (SELECT persistence_id FROM sited WHERE sequence_nr <= 3 GROUP BY 1 HAVING bool_or(list_contains(named, 'us') OR list_contains(named, '*')))
SELECT persistence_id, sequence_nr FROM log WHERE (persistence_id IN (SELECT persistence_id FROM vis WHERE us AND master) AND persistence_id NOT IN (SELECT persistence_id FROM early))
OR (sequence_nr > 3 AND persistence_id IN (SELECT persistence_id FROM early))""")
def backfill_history(spark, sf_dir):
    events = _log(spark, sf_dir)
    found = visibility.forward(events, events.where("sequence_nr > 3"), _visibility(spark, sf_dir, 3), _visibility(spark, sf_dir), "us")
    return found.select("persistence_id", "sequence_nr")


@query("""WITH {LOG}, gap AS (SELECT persistence_id, min(sequence_nr) FILTER (WHERE event_id % 13 = 0 AND sequence_nr > 5) AS lost FROM log GROUP BY 1)
SELECT persistence_id, CAST(count(*) FILTER (WHERE lost IS NULL OR sequence_nr < lost) AS BIGINT) AS applied,
CAST(count(*) FILTER (WHERE lost IS NOT NULL AND sequence_nr > lost AND event_id % 13 <> 0) AS BIGINT) AS waiting FROM log JOIN gap USING (persistence_id) GROUP BY 1""")
def replica_apply(spark, sf_dir):
    events = _log(spark, sf_dir)
    stored = events.where("sequence_nr <= 5")
    arriving = events.where("sequence_nr > 3 and (sequence_nr <= 5 or event_id % 13 <> 0)")
    done, waiting = visibility.apply_replica(stored, arriving)
    both = done.select("persistence_id", F.lit(1).alias("a"), F.lit(0).alias("w")).union(waiting.select("persistence_id", F.lit(0), F.lit(1)))
    return both.groupBy("persistence_id").agg(F.sum("a").alias("applied"), F.sum("w").alias("waiting"))


@query("""WITH {LOG}, c AS (SELECT *, CASE WHEN tag = 'error' THEN 'error' WHEN value <= coalesce(max(value) FILTER (WHERE tag <> 'error') OVER (PARTITION BY persistence_id ORDER BY sequence_nr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1e300) THEN 'already applied' ELSE 'ok' END AS outcome FROM log)
SELECT persistence_id, outcome, CAST(count(*) AS BIGINT) AS n FROM c GROUP BY 1, 2""")
def command_results(spark, sf_dir):
    """Commands that raise an entity's record: errors are rejected, what isn't above the record is already applied, the rest become events."""
    before = Window.partitionBy("persistence_id").orderBy("sequence_nr").rowsBetween(Window.unboundedPreceding, -1)
    record = F.coalesce(F.max(F.when(F.col("tag") != "error", F.col("value"))).over(before), F.lit(-1e300))
    found = _log(spark, sf_dir).withColumn("record", record)
    outcome = F.when(F.col("tag") == "error", "error").when(F.col("value") <= F.col("record"), "already applied").otherwise("ok")
    return found.groupBy("persistence_id", outcome.alias("outcome")).agg(F.count("*").alias("n"))


# Codecs


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def json_fields(spark, sf_dir):
    events = read_table(spark, sf_dir, "events").select("event_id", "props")
    return json_codec.read(events, "props", json_codec.Object({"k": json_codec.Scalar("bigint")})).select("event_id", "value.k")


@query("SELECT event_id, unnest(json_keys(props)) AS name, json_extract_string(props, '$.k') AS text FROM events")
def json_any_field(spark, sf_dir):
    events = read_table(spark, sf_dir, "events").select("event_id", "props")
    return json_codec.read(events, "props", json_codec.AnyField(json_codec.Scalar("string"))).select("event_id", F.explode("value").alias("name", "text"))


@query("""SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN CAST(event_id AS BIGINT) WHEN event_type = 'purchase' THEN -CAST(event_id AS BIGINT) END AS v,
event_type NOT IN ('click', 'view', 'purchase') AS failed FROM events""")
def json_alternatives(spark, sf_dir):
    events = read_table(spark, sf_dir, "events").select("event_id", "event_type")
    text = F.when(F.col("event_type") == "purchase", F.to_json(F.struct(F.lit("2").alias("alternative"), F.col("event_id").alias("b"))))
    text = text.when(F.col("event_type").isin("click", "view"), F.to_json(F.struct(F.lit("1").alias("alternative"), F.col("event_id").cast("string").alias("a"))))
    text = text.otherwise(F.to_json(F.struct(F.lit("3").alias("alternative"))))
    one = json_codec.Object({"a": json_codec.Scalar("bigint")}, having={"alternative": "1"}).map(lambda v: v["a"])
    two = json_codec.Object({"b": json_codec.Scalar("bigint")}, having={"alternative": "2"}).map(lambda v: -v["b"])
    value, error = json_codec.any_of(F.col("doc"), one, two)
    return events.withColumn("doc", text).select("event_id", value.alias("v"), error.isNotNull().alias("failed"))


@query("""SELECT doc_id, nullif(text, '') AS text, '"' || source || '";' AS odd, CAST(n_chars AS BIGINT) AS n_chars FROM documents WHERE doc_id IS NOT NULL""")
def csv_roundtrip(spark, sf_dir):
    """Whole texts, with quotes, separators, blanks and line ends, as CSV records and back."""
    cols = ["doc_id", "text", "odd", "n_chars"]
    docs = read_table(spark, sf_dir, "documents").where("doc_id is not null")
    docs = docs.withColumn("odd", F.concat(F.lit('"'), "source", F.lit('";')))
    lines = docs.select(csv_codec.line([F.col(c) for c in cols]).alias("line"))
    back = csv_codec.decode(lines, "line", cols, {"doc_id": "bigint", "text": "string", "odd": "string", "n_chars": "bigint"}, optional=("text",), settings=csv_codec.CsvSettings(longest_cell=(1 << 31) - 1))
    return back.where("error is null").select(*cols)


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'a"b|c;' || event_type WHEN 1 THEN '~|' || event_type || chr(13) WHEN 2 THEN 'x' || chr(10) || 'y|~|z' ELSE 'open;' || event_type END AS cells FROM events""")
def csv_edge_cases(spark, sf_dir):
    """Records with doubled quotes, quoted separators and line ends, carriage returns, empty cells, a quote that isn't closed."""
    kind, n = F.col("event_type"), F.col("event_id") % 4
    record = F.when(n == 0, F.concat(F.lit('"a""b";"c;'), kind, F.lit('"'))).when(n == 1, F.concat(F.lit('"";'), kind, F.lit("\r")))
    record = record.when(n == 2, F.lit('"x\ny";;z')).otherwise(F.concat(F.lit('"open;'), kind))
    return read_table(spark, sf_dir, "events").select("event_id", F.array_join(csv_codec.cells(record), "|", "~").alias("cells"))


@query("SELECT event_id, CAST(event_id AS BIGINT) AS a, CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'none' END AS b FROM events WHERE event_id % 3 <> 0")
def json_duplicates(spark, sf_dir):
    """Of repeated fields the last counts, a missing optional one has its default, an object without the required one is left out."""
    a = F.when(F.col("event_id") % 3 != 0, F.concat(F.lit(',"a":"'), "event_id", F.lit('"'))).otherwise("")
    b = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(',"b":"'), "event_type", F.lit('"'))).otherwise("")
    start = F.when(F.col("event_id") % 3 != 0, F.lit('{"a":1,"c":{}')).otherwise('{"c":{}')
    docs = read_table(spark, sf_dir, "events").select("event_id", F.concat(start, a, b, F.lit("}")).alias("doc"))
    proto = json_codec.Object({"a": json_codec.Scalar("bigint"), "b": json_codec.Scalar("string")}, optional=("b",), defaults={"b": "none"})
    return json_codec.read(docs, "doc", proto).select("event_id", "value.a", "value.b")


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN CAST(event_id AS BIGINT) END AS object_a, CASE event_id % 5 WHEN 1 THEN 2 END AS n, event_id % 5 = 4 AS failed FROM events")
def json_roots(spark, sf_dir):
    """Objects, arrays, numbers and null as whole documents, read as an object and as an array."""
    n = F.col("event_id") % 5
    doc = F.when(n == 0, F.concat(F.lit('{"a":'), "event_id", F.lit("}"))).when(n == 1, F.lit('[7,null,"8"]')).when(n == 2, F.lit("5")).when(n == 3, F.lit("null")).otherwise("{")
    events = read_table(spark, sf_dir, "events").select("event_id", doc.alias("doc"))
    one, wrong = json_codec.decoded(F.col("doc"), json_codec.Object({"a": json_codec.Scalar("bigint")}))
    many, _ = json_codec.decoded(F.col("doc"), json_codec.Each(json_codec.Scalar("int")))
    return events.select("event_id", one["a"].alias("object_a"), F.when(many.isNotNull(), F.size(many)).alias("n"), wrong.isNotNull().alias("failed"))


@query("""SELECT event_id, '{"kind":"event","id":' || event_id || CASE WHEN event_id % 2 = 0 THEN ',"tags":["' || event_type || '"]' ELSE '' END || '}' AS doc FROM events""")
def json_write(spark, sf_dir):
    """Constants first, empty optional arrays and null fields not written."""
    tags = F.when(F.col("event_id") % 2 == 0, F.array("event_type")).otherwise(F.array().cast("array<string>"))
    value = F.struct(F.col("event_id").alias("id"), tags.alias("tags"), F.lit(None).cast("string").alias("gone"))
    return read_table(spark, sf_dir, "events").select("event_id", json_codec.write(value, {"kind": "event"}, ("tags",)).alias("doc"))


@query("""WITH {LOG}, r AS (SELECT persistence_id, sequence_nr, CASE WHEN value > 100 THEN 1 ELSE 0 END AS s, value FROM log),
m AS (SELECT *, CASE WHEN s = lag(s) OVER (PARTITION BY persistence_id ORDER BY sequence_nr) THEN 0 ELSE 1 END AS opens FROM r),
g AS (SELECT *, sum(opens) OVER (PARTITION BY persistence_id ORDER BY sequence_nr) AS run FROM m)
SELECT persistence_id, min(sequence_nr) AS sequence_nr, CAST(count(*) AS BIGINT) AS n FROM g WHERE s = 1 GROUP BY persistence_id, run
UNION ALL SELECT persistence_id, sequence_nr, 1 FROM g WHERE s = 0""")
def runs_through_target(spark, sf_dir):
    """Each run of rows above a value becomes one row, the others stay."""
    rows = _log(spark, sf_dir).select("persistence_id", "sequence_nr", "value", F.lit(1).cast("bigint").alias("n"))
    joined = lambda d: d.groupBy("persistence_id", "run").agg(F.min("sequence_nr").alias("sequence_nr"), F.max("value").alias("value"), F.sum("n").alias("n"))
    done = runs.run_targets(rows, ["persistence_id"], ["sequence_nr"], F.col("value") > 100, joined)
    return done.select("persistence_id", "sequence_nr", "n")


@query("WITH {LOG} SELECT persistence_id, sequence_nr, CAST(sum(CAST(floor(value) AS BIGINT)) OVER (PARTITION BY persistence_id ORDER BY sequence_nr) AS BIGINT) AS total FROM log")
def running_total(spark, sf_dir):
    events = log.require_rows(_log(spark, sf_dir))
    return fold.running(events, ["persistence_id"], ["sequence_nr"], F.floor("value"), "total").select("persistence_id", "sequence_nr", "total")


@query("WITH {LOG} SELECT persistence_id, sequence_nr, tag FROM log WHERE tag = 'click' AND timestamp_ms >= epoch_ms(TIMESTAMP '2024-01-05') AND timestamp_ms < epoch_ms(TIMESTAMP '2024-01-12')")
def stored_slice(spark, sf_dir):
    """A slice of a log that was numbered and stored by tag and day."""
    path = new_path(spark, "log")
    log.store(_log(spark, sf_dir), path)
    return log.stored(spark, path, "click", 1_704_412_800_000, 1_705_017_600_000).select("persistence_id", "sequence_nr", "tag")


@query("WITH {LOG} SELECT persistence_id, sequence_nr, timestamp_ms FROM log WHERE tag = 'purchase'")
def backup_restore(spark, sf_dir):
    """A tag's events from a backup of the whole log in chunks."""
    path = new_path(spark, "backup")
    chunks.backup(_log(spark, sf_dir), path, 1000)
    return framing.decode_frames(chunks.restore(spark, path, "purchase"), "message").select("persistence_id", "sequence_nr", "timestamp_ms")


@query("""SELECT c_custkey, concat_ws(';', '"' || c_custkey || '"', '"' || replace(c_name, '"', '""') || '"', '"' || c_mktsegment || '"') AS line FROM customer""")
def csv_render(spark, sf_dir):
    return read_table(spark, sf_dir, "customer").select("c_custkey", csv_codec.line([F.col("c_custkey"), F.col("c_name"), F.col("c_mktsegment")]).alias("line"))


@query("""SELECT page_id, CASE WHEN regexp_full_match(url, '(https?)://([^/]+)/.*') THEN regexp_extract(url, '^(https?)://([^/]+)/.*$', 1) END AS scheme,
CASE WHEN regexp_full_match(url, '(https?)://([^/]+)/.*') THEN regexp_extract(url, '^(https?)://([^/]+)/.*$', 2) END AS host FROM pages""")
def regex_extract(spark, sf_dir):
    pattern = r"(https?)://([^/]+)/.*"
    return read_table(spark, sf_dir, "pages").select("page_id", full_match(F.col("url"), pattern, 1).alias("scheme"), full_match(F.col("url"), pattern, 2).alias("host"))


@query(f"""WITH h AS (SELECT DISTINCT user_id, sha1(unhex('{NAMESPACE.replace("-", "")}') || encode(CAST(user_id AS VARCHAR))) AS h FROM events)
SELECT user_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || CASE WHEN h[17] IN ('0','4','8','c') THEN '8' WHEN h[17] IN ('1','5','9','d') THEN '9' WHEN h[17] IN ('2','6','a','e') THEN 'a' ELSE 'b' END || h[18:20] || '-' || h[21:32] AS uuid FROM h""")
def uuid_named(spark, sf_dir):
    return read_table(spark, sf_dir, "events").select("user_id").distinct().withColumn("uuid", uuid_v5(NAMESPACE, F.col("user_id").cast("string")))


@query("""WITH {LOG}, t AS (SELECT event_id, timestamp_ms, lpad(lower(to_hex((timestamp_ms + 12219292800000) * 10000)), 16, '0') AS h FROM log)
SELECT event_id, timestamp_ms AS back_ms, h[9:16] || '-' || h[5:8] || '-1' || h[2:4] || '-8080-808080808080' AS uuid FROM t""")
def uuid_time(spark, sf_dir):
    made = _log(spark, sf_dir).withColumn("uuid", uuid_start_of(F.col("timestamp_ms")))
    return made.select("event_id", uuid_timestamp(F.col("uuid")).alias("back_ms"), "uuid")


@query("""WITH RECURSIVE names AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS s FROM events),
f AS (SELECT s, 1 AS i, CAST(0 AS BIGINT) AS h FROM names UNION ALL SELECT s, i + 1, (h * 31 + ascii(substr(s, i, 1))) % 4294967296 FROM f WHERE i <= length(s))
SELECT s AS persistence_id, CAST((CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END) % 256 AS INTEGER) AS shard FROM f WHERE i = length(s) + 1""")
def shard_numbers(spark, sf_dir):
    return _log(spark, sf_dir).select("persistence_id").distinct().withColumn("shard", java_shard(F.col("persistence_id")))


@query("SELECT doc_id, text AS back, CAST(length(base64(encode(text))) AS BIGINT) AS n FROM documents")
def base64_roundtrip(spark, sf_dir):
    coded = read_table(spark, sf_dir, "documents").withColumn("line", base64_line(F.encode("text", "UTF-8")))
    return coded.select("doc_id", F.decode(base64_bytes(F.col("line")), "UTF-8").alias("back"), F.length("line").cast("bigint").alias("n"))


@query("SELECT doc_id, text AS back, CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes FROM documents")
def charset_check(spark, sf_dir):
    coded = read_table(spark, sf_dir, "documents").withColumn("raw", encode_strict(F.col("text"), "UTF-8"))
    return coded.select("doc_id", decode_strict(F.col("raw"), "UTF-8").alias("back"), F.octet_length("raw").cast("bigint").alias("n_bytes"))


@query("WITH {LOG} SELECT tag || '-from-' || strftime(make_timestamp(min(timestamp_ms) * 1000), '%Y_%m_%d_%H_%M_%S_%g') AS key, min(timestamp_ms) AS start_ms FROM log GROUP BY tag")
def chunk_keys(spark, sf_dir):
    first = _log(spark, sf_dir).groupBy("tag").agg(F.min("timestamp_ms").alias("ms"))
    return first.select(chunk_key(F.col("tag"), F.col("ms")).alias("key")).withColumn("start_ms", chunk_start(F.col("key")))


@query("WITH {LOG} SELECT persistence_id, sequence_nr, timestamp_ms, event FROM log")
def framing_roundtrip(spark, sf_dir):
    message = framing.envelope_frame("persistence_id", "sequence_nr", "timestamp_ms", F.col("event").cast("binary"))
    back = framing.decode_frames(_log(spark, sf_dir).select(message.alias("content")))
    return back.withColumn("event", F.col("event").cast("string"))


ORDER_XSD = Path(__file__).with_name("order.xsd")


def _order_documents(spark, sf_dir):
    items = read_table(spark, sf_dir, "lineitem")
    item = F.concat(F.lit("<item><part>"), F.col("l_partkey"), F.lit("</part><quantity>"), F.floor("l_quantity"), F.lit("</quantity><extra/></item>"))
    inside = items.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", item.alias("x")))).alias("items"))
    orders = read_table(spark, sf_dir, "orders").join(inside, "o_orderkey")
    body = F.array_join(F.transform("items", lambda i: i["x"]), "")
    return orders.select("o_orderkey", F.concat(F.lit('<order id="'), "o_orderkey", F.lit('"><customer>'), "o_custkey", F.lit("</customer>"), body, F.lit("</order>")).alias("doc"))


@query("""WITH i AS (SELECT l_orderkey, string_agg('{"part":"' || l_partkey || '","quantity":"' || CAST(floor(l_quantity) AS BIGINT) || '"}', ',' ORDER BY l_linenumber, l_partkey || '</part><quantity>' || CAST(floor(l_quantity) AS BIGINT) || '<') AS items FROM lineitem GROUP BY 1)
SELECT o_orderkey, '{"customer":"' || o_custkey || '","item":[' || items || '],"id":"' || o_orderkey || '"}' AS json FROM orders JOIN i ON l_orderkey = o_orderkey""")
def xml_to_json(spark, sf_dir):
    schema, _ = xsd.parse(ORDER_XSD.read_text())
    return _order_documents(spark, sf_dir).select("o_orderkey", xsd.xml_to_json(F.col("doc"), schema, "order").alias("json"))


@query("SELECT o_orderkey, o_orderkey % 3 <> 0 AS valid FROM orders")
def xml_validate(spark, sf_dir):
    """Documents against a schema: of every third order the customer is missing."""
    schema, _ = xsd.parse(ORDER_XSD.read_text())
    orders = read_table(spark, sf_dir, "orders")
    body = F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("<customer>"), "o_custkey", F.lit("</customer>"))).otherwise("")
    docs = orders.select("o_orderkey", F.concat(F.lit('<order id="1">'), body, F.lit("<item><part>1</part><quantity>2</quantity></item></order>")).alias("doc"))
    return docs.select("o_orderkey", xsd.is_valid(F.col("doc"), schema, "order", xsd.share(spark, ORDER_XSD.read_text())).alias("valid"))


SPACED_XSD = """<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema" xmlns:p="urn:party" targetNamespace="urn:party"><xs:element name="party"><xs:complexType><xs:sequence>
<xs:element ref="p:key"/><xs:group ref="p:place" minOccurs="0"/></xs:sequence></xs:complexType></xs:element><xs:element name="key" type="p:Key"/>
<xs:complexType name="Key"><xs:simpleContent><xs:extension base="xs:string"><xs:attribute name="kind"/></xs:extension></xs:simpleContent></xs:complexType>
<xs:group name="place"><xs:sequence><xs:element name="nation" type="xs:string" maxOccurs="unbounded"/></xs:sequence></xs:group></xs:schema>"""


@query("""SELECT s_suppkey, '{"key":{"kind":"s","value":"' || s_suppkey || '"},"nation":["' || s_nationkey || '"]}' AS json FROM supplier""")
def xml_groups(spark, sf_dir):
    """References, groups and text with attributes of a schema with a namespace."""
    schema, _ = xsd.parse(SPACED_XSD)
    doc = F.concat(F.lit('<party><key kind="s">'), "s_suppkey", F.lit("</key><nation>"), "s_nationkey", F.lit("</nation></party>"))
    return read_table(spark, sf_dir, "supplier").select("s_suppkey", xsd.xml_to_json(doc, schema, "party").alias("json"))


# XML by qualified name

#: Parts of two makers: tags of one local name in two namespaces, some of them deeper.
HOME, AWAY = "urn:home", "urn:away"


def _party_documents(spark, sf_dir):
    parts = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    key, name, size = F.col("p_partkey"), F.col("p_name"), F.col("p_size")
    head = F.concat(F.lit(f'<h:parts xmlns:h="{HOME}" xmlns:w="{AWAY}"><h:part size="'), size, F.lit('">'), name, F.lit("</h:part>"))
    deep = F.when(key % 2 == 0, F.concat(F.lit("<group><w:part>"), key, F.lit("</w:part><h:part><h:part>inner</h:part></h:part></group>"))).otherwise(F.lit('<w:part size="0"/>'))
    return parts.select("p_partkey", F.concat(head, deep, F.lit("</h:parts>")).alias("doc"))


@query("""SELECT p_partkey, CAST(2 AS BIGINT) AS tag, '<h:part xmlns:h="urn:home" size="' || p_size || '">' || p_name || '</h:part>' AS doc FROM part
UNION ALL SELECT p_partkey, CAST(9 AS BIGINT), '<h:part xmlns:h="urn:home"><h:part>inner</h:part></h:part>' FROM part WHERE p_partkey % 2 = 0""")
def xml_select(spark, sf_dir):
    """Every outermost tag of one namespace and name, at any depth, as a document of its own."""
    events = xml_events.events(_party_documents(spark, sf_dir), "doc")
    picked = events.withColumn("tag", xml_events.sub_tag(F.col("event"), xml_events.qname("part", HOME))).where("tag is not null")
    return xml_events.documents(picked, ["p_partkey", "tag"])


@query("SELECT p_partkey, '{urn:home}part' AS name, p_name AS text FROM part")
def xml_any_tag_map(spark, sf_dir):
    """Bodies of the tags right below the root by qualified name; tags without a body are nothing."""
    found = xml_events.map_of(xml_events.tags(_party_documents(spark, sf_dir), "doc"), ["p_partkey"], None)
    return found.select("p_partkey", F.explode("values").alias("name", "text"))


@query("""SELECT p_partkey, 'part' AS name, CASE WHEN p_partkey % 2 = 1 THEN '0' ELSE CAST(p_size AS VARCHAR) END AS text FROM part""")
def xml_attribute_map(spark, sf_dir):
    """An attribute of the tags right below the root by local name: of two namespaces' tags with one local name the last counts."""
    found = xml_events.map_of(xml_events.tags(_party_documents(spark, sf_dir), "doc"), ["p_partkey"], None, of="size", local=True)
    return found.select("p_partkey", F.explode("values").alias("name", "text"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0 THEN o_custkey END AS customer, CASE WHEN o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0 THEN CAST(7 AS INTEGER) END AS level,
nullif(concat_ws('; ', CASE WHEN o_orderkey % 3 = 0 THEN 'Expecting bigint but was c' || o_custkey || ' at 2:' || (12 + length('c' || o_custkey)) END,
  CASE WHEN o_orderkey % 5 = 0 THEN 'Expecting int but was high at 1:21' END), '') AS error FROM orders WHERE o_orderkey % 7 <> 0""")
def xml_places(spark, sf_dir):
    """Typed records with errors at a line and column: a body behind its last character, an attribute behind its tag; without the required customer no record."""
    key = F.col("o_orderkey")
    level = F.when(key % 5 == 0, F.lit('<order level="high">')).otherwise(F.lit('<order level="7">'))
    wrong = F.when(key % 3 == 0, "c").otherwise("")
    body = F.when((key % 7 == 0) & (key % 5 != 0), F.lit("<customer/>")).when(key % 7 == 0, F.lit("<gone/>")).otherwise(F.concat(F.lit("<customer>"), wrong, "o_custkey", F.lit("</customer>")))
    docs = read_table(spark, sf_dir, "orders").where("o_orderkey % 7 <> 0 or o_orderkey % 5 <> 0").select("o_orderkey", F.concat(level, F.lit("\n "), body, F.lit("</order>")).alias("doc"))
    fields = {"customer": xml_events.Part("customer", "bigint"), "level": xml_events.Part("level", "int", attribute=True)}
    return xml_events.records(xml_events.tags(docs, "doc"), ["o_orderkey"], fields, "order").drop("tag")


@query("""SELECT s_suppkey, '<p:party xmlns:p="urn:home" xmlns:q="urn:away" q:key="' || s_suppkey || '"><p:nation>' || s_nationkey || '</p:nation><q:note xmlns:p="urn:other"><p:x/>a &amp; b</q:note></p:party>' AS doc FROM supplier""")
def xml_roundtrip(spark, sf_dir):
    """Documents as events and written again: declarations that hold already go, texts are escaped anew, CDATA and comments are plain text and nothing."""
    doc = F.concat(
        F.lit(f'<p:party xmlns:p="{HOME}" xmlns:q="{AWAY}" q:key="'), "s_suppkey", F.lit(f'"><p:nation xmlns:p="{HOME}">'), "s_nationkey",
        F.lit(f'</p:nation><!-- gone --><q:note xmlns:q="{AWAY}" xmlns:p="urn:other"><p:x></p:x><![CDATA[a & b]]></q:note></p:party>'),
    )
    docs = read_table(spark, sf_dir, "supplier").select("s_suppkey", doc.alias("doc"))
    return xml_events.documents(xml_events.events(docs, "doc"), ["s_suppkey"])


# JSON by kind, and both ways


@query("""WITH d AS (SELECT event_id, event_type, CAST(event_id AS BIGINT) % 8 AS n FROM events)
SELECT event_id, CASE n WHEN 0 THEN CAST(event_id AS BIGINT) WHEN 3 THEN CAST(event_id AS BIGINT) WHEN 6 THEN CAST(event_id AS BIGINT) END AS id,
CASE n WHEN 0 THEN event_type WHEN 6 THEN '{' || event_type || '"[' END AS name, CASE WHEN n IN (4, 5, 7) THEN 'not JSON' WHEN n = 2 THEN 'Expecting bigint but was x at $.id' END AS error
FROM d WHERE n <> 1""")
def json_strict(spark, sf_dir):
    """Objects and arrays under scalars are nothing, strings that look like them are strings; text behind a document is an error."""
    key, n = F.col("event_id"), F.col("event_id") % 8
    doc = F.when(n == 0, F.concat(F.lit('{"id":'), key, F.lit(',"name":"'), "event_type", F.lit('"}'))).when(n == 1, F.concat(F.lit('{"id":{"id":'), key, F.lit("}}")))
    doc = doc.when(n == 2, F.lit('{"id":"x"}')).when(n == 3, F.concat(F.lit('{"id":'), key, F.lit(',"name":["a"]}'))).when(n == 4, F.concat(F.lit('{"id":'), key, F.lit("} trailing")))
    doc = doc.when(n == 5, F.concat(F.lit('{"id":'), key, F.lit("}]"))).when(n == 6, F.concat(F.lit('{"id":"'), key, F.lit('","name":"{'), "event_type", F.lit('\\"["}'))).otherwise(F.lit("{'id':1}"))
    docs = read_table(spark, sf_dir, "events").select("event_id", doc.alias("doc"))
    proto = json_codec.Object({"id": json_codec.Scalar("bigint"), "name": json_codec.Scalar("string")}, optional=("name",))
    return json_codec.read(docs, "doc", proto).select("event_id", "value.id", "value.name", "error")


@query("""SELECT event_id, CAST(event_id AS BIGINT) AS id, event_type AS tag FROM events WHERE event_id % 3 <> 2
UNION ALL SELECT event_id, CAST(-event_id AS BIGINT), 'second' FROM events WHERE event_id % 3 = 0""")
def json_streamed_fields(spark, sf_dir):
    """Objects out of every field of an object in each document, one row each; what is nothing gives no row."""
    key, n = F.col("event_id"), F.col("event_id") % 3
    first = F.concat(F.lit('{"id":'), key, F.lit(',"tag":"'), "event_type", F.lit('"}'))
    doc = F.when(n == 0, F.concat(F.lit('{"all":{"a":'), first, F.lit(',"b":5,"c":{"id":-'), key, F.lit(',"tag":"second"}}}'))).when(n == 1, F.concat(F.lit('{"all":{"z":'), first, F.lit("}}"))).otherwise(F.lit('{"all":[]}'))
    docs = read_table(spark, sf_dir, "events").select("event_id", doc.alias("doc"))
    item = json_codec.Object({"id": json_codec.Scalar("bigint"), "tag": json_codec.Scalar("string")})
    return json_codec.elements(docs, "doc", ["all", json_codec.ANY], item).select("event_id", "element.id", "element.tag")


@query("""SELECT o_orderkey, '{"kind":"order","version":2,"id":' || o_orderkey || ',"customer":{"key":"' || o_custkey || '"}' || CASE WHEN o_orderkey % 2 = 0 THEN ',"marks":[' || o_orderkey % 10 || ',7]' ELSE '' END
|| ',"more":{"a":1,"b":[' || o_custkey || ']}}' AS doc FROM orders""")
def json_two_way(spark, sf_dir):
    """Documents read and written again by one tree: constants, a mapped field, an optional array, a part of a type of its own."""
    c = json_codec
    tree = c.Object(
        {
            "id": c.Scalar("bigint").map(lambda v: v * 2, back=lambda v: (v / 2).cast("bigint")), "customer": c.Object({"key": c.Scalar("string")}),
            "marks": c.Each(c.Many(c.Scalar("int"))), "more": c.Typed("struct<a:int,b:array<bigint>>"),
        },
        optional=("marks",), having={"kind": "order", "version": 2},
    )
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    marks = F.when(key % 2 == 0, F.concat(F.lit(' "marks" : ["'), key % 10, F.lit('",null,{}, 7],'))).otherwise(F.when(key % 3 == 0, F.lit('"marks":[],')).otherwise(""))
    doc = F.concat(F.lit('{"version":"2", "id":"'), key, F.lit('",'), marks, F.lit('"unknown":[{}],"customer":{"key":'), customer, F.lit('},"kind":"order","more":{"b":['), customer, F.lit('],"a":1,"x":0}}'))
    docs = read_table(spark, sf_dir, "orders").select("o_orderkey", doc.alias("doc"))
    return c.read(docs, "doc", tree).select("o_orderkey", c.encoded(F.col("value"), tree).alias("doc"))


# Roles and control tables

NAMED_SQL = """named AS (SELECT *, CASE WHEN tag = 'signup' THEN ['eu', '*'] WHEN tag = 'purchase' THEN ['eu'] WHEN tag = 'error' THEN ['us'] END AS sites FROM log)"""


def _named(spark, sf_dir):
    sites = F.when(F.col("tag") == "signup", F.array(F.lit("eu"), F.lit("*"))).when(F.col("tag") == "purchase", F.array(F.lit("eu"))).when(F.col("tag") == "error", F.array(F.lit("us")))
    return _log(spark, sf_dir).withColumn("sites", sites)


@query("WITH {LOG}, " + NAMED_SQL + """, past AS (SELECT persistence_id, COALESCE(CASE WHEN arg_min(sites[1], sequence_nr) FILTER (WHERE sites IS NOT NULL) = 'eu' THEN 'master' WHEN count(sites) > 0 THEN 'slave' END, 'master') AS known
  FROM named WHERE CAST(persistence_id AS BIGINT) % 4 <> 0 AND sequence_nr <= 3 GROUP BY 1),
m AS (SELECT n.*, known, CASE event_id % 3 WHEN 0 THEN 'read' WHEN 1 THEN 'write' ELSE 'event' END AS kind FROM named n LEFT JOIN past USING (persistence_id) WHERE CAST(persistence_id AS BIGINT) % 4 = 0 OR sequence_nr > 3),
r AS (SELECT *, COALESCE(known, first_value(CASE WHEN kind = 'event' THEN 'slave' WHEN kind = 'write' AND sites[1] = 'eu' THEN 'master' END IGNORE NULLS) OVER (PARTITION BY persistence_id ORDER BY sequence_nr ROWS UNBOUNDED PRECEDING)) AS role FROM m)
SELECT persistence_id, sequence_nr AS message_nr, role, CASE WHEN role IS NULL THEN CASE kind WHEN 'read' THEN 'not found' ELSE 'invalid first event' END WHEN kind = 'event' AND role = 'master' OR kind = 'write' AND role = 'slave' THEN 'wrong side' ELSE 'ok' END AS outcome FROM r""")
def replica_roles(spark, sf_dir):
    """What becomes of reads, writes and events from elsewhere at a site, for entities with a history there and new ones."""
    named = _named(spark, sf_dir)
    old = (F.col("persistence_id").cast("bigint") % 4 != 0) & (F.col("sequence_nr") <= 3)
    n = F.col("event_id") % 3
    kind = F.when(n == 0, roles.READ).when(n == 1, roles.WRITE).otherwise(roles.EVENT)
    messages = named.where(~old).select("persistence_id", F.col("sequence_nr").alias("message_nr"), kind.alias("kind"), "sites")
    return roles.outcomes(named.where(old), messages, "eu").select("persistence_id", "message_nr", "role", "outcome")


@query("WITH {LOG}, " + NAMED_SQL + """ SELECT persistence_id, CAST(max(sequence_nr) + 1 AS BIGINT) AS sequence_nr, 'eu' AS site FROM named WHERE sequence_nr <= 3 GROUP BY 1 HAVING count(sites) = 0""")
def role_migrations(spark, sf_dir):
    """The event that pins each entity from before replication to this site."""
    found = roles.migrations(_named(spark, sf_dir).where("sequence_nr <= 3"), "eu")
    return found.select("persistence_id", "sequence_nr", F.explode("sites").alias("site"))


@query("WITH {LOG}, " + NAMED_SQL + """ SELECT persistence_id, arg_max(tag = 'purchase', sequence_nr) AS master, array_to_string(list_sort(list_distinct(flatten(list(sites)))), ',') AS sites FROM named WHERE sites IS NOT NULL GROUP BY 1""")
def visibility_upsert(spark, sf_dir):
    """A stored visibility table after five batches, one of which comes twice: sites add up, the master is the last one set."""
    table = control.visibility(spark, new_path(spark, "visibility"), 16)
    named = _named(spark, sf_dir).where("sites is not null").withColumn("master", F.col("tag") == "purchase")
    for number in (0, 1, 1, 2, 3, 4):
        part = named.where((F.col("sequence_nr") > 20 * number) & ((F.col("sequence_nr") <= 20 * (number + 1)) | F.lit(number == 4)))
        table.upsert(part, number, F.col("sequence_nr"))
    return table.read().select("persistence_id", "master", F.array_join("sites", ",").alias("sites"))


@query("""WITH {LOG}, o AS (SELECT 'eu' AS site, tag, max(timestamp_ms) AS "offset" FROM log GROUP BY 2), k AS (SELECT site, tag FROM (VALUES ('eu'), ('us')) s(site), (SELECT DISTINCT tag FROM log))
SELECT site, tag, COALESCE("offset", 0) AS "offset" FROM k LEFT JOIN o USING (site, tag)""")
def control_offsets(spark, sf_dir):
    """Offsets by site and tag, written twice; those never written are 0."""
    table = control.offsets(spark, new_path(spark, "offsets"))
    last = _log(spark, sf_dir).groupBy(F.lit("eu").alias("site"), "tag").agg(F.max("timestamp_ms").alias("offset"))
    table.upsert(last.withColumn("offset", F.lit(5)))
    table.upsert(last)
    wanted = last.select(F.explode(F.array(F.lit("eu"), F.lit("us"))).alias("site"), "tag")
    return table.lookup(wanted, offset=0)


# Byte streams


@query("WITH {LOG} SELECT persistence_id AS stream, sequence_nr - 1 AS place, sequence_nr, timestamp_ms - 1704800000000 AS timestamp_ms, event FROM log")
def framing_chunks(spark, sf_dir):
    """Each entity's messages as one byte stream, cut every 61 bytes whatever is there, and read again; some times are before 1970."""
    early = _log(spark, sf_dir).withColumn("timestamp_ms", F.col("timestamp_ms") - 1_704_800_000_000)
    frames = early.select("persistence_id", "sequence_nr", framing.envelope_frame("persistence_id", "sequence_nr", "timestamp_ms", "event").alias("content"))
    streams = framing.concatenated(frames, ["persistence_id"], "sequence_nr").withColumnRenamed("persistence_id", "stream")
    back = framing.decode_chunks(framing.cut(streams, "content", 61), "stream", "nr")
    return back.select("stream", "place", "sequence_nr", "timestamp_ms", F.col("event").cast("string").alias("event"))


# Schemas: repeats, recursion, simple types

REPEATS_XSD = """<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:element name="rec"><xs:complexType mixed="true"><xs:sequence>
<xs:element name="key" type="xs:string"/><xs:element name="value" type="xs:int" minOccurs="0"/><xs:element name="key" type="xs:string" minOccurs="0"/></xs:sequence></xs:complexType></xs:element></xs:schema>"""


@query("""SELECT p_partkey, '{"key":["' || p_size || '"' || CASE WHEN p_partkey % 2 = 0 THEN ',"second"' ELSE '' END || '],"value":"7","_value":"a b' || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE ' ' END || p_partkey || '"}' AS json FROM part""")
def xml_repeats(spark, sf_dir):
    """An element that a type names twice is an array; mixed text is whole but for blanks alone between tags, and has another name where a child is called value."""
    schema, _ = xsd.parse(REPEATS_XSD)
    key = F.col("p_partkey")
    again = F.when(key % 2 == 0, F.lit("<key>second</key>")).otherwise("")
    doc = F.concat(F.lit("<rec>a <key>"), "p_size", F.lit("</key>b<!-- x --><value>7</value> "), again, key, F.lit("</rec>"))
    return read_table(spark, sf_dir, "part").select("p_partkey", xsd.xml_to_json(doc, schema, "rec").alias("json"))


TREE_XSD = """<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema" xmlns:t="urn:tree" targetNamespace="urn:tree"><xs:element name="node" type="t:Node"/>
<xs:complexType name="Node"><xs:sequence><xs:element name="node" type="t:Node" minOccurs="0"/></xs:sequence><xs:attribute name="id"/></xs:complexType></xs:schema>"""


@query("""SELECT p_partkey, repeat('{"node":', p_partkey % 8) || '{"id":"0"}' || array_to_string(list_transform(range(1, p_partkey % 8 + 1), lambda i: ',"id":"' || i || '"}'), '') AS json FROM part""")
def xml_recursive(spark, sf_dir):
    """Trees of up to eight levels by a recursive type."""
    schema, _ = xsd.parse(TREE_XSD)
    depth = (F.col("p_partkey") % 8).cast("int")
    opens = F.array_join(F.transform(F.sequence(depth, F.lit(0), F.lit(-1)), lambda i: F.concat(F.lit('<node id="'), i, F.lit('">'))), "")
    doc = F.concat(opens, F.repeat(F.lit("</node>"), depth + 1))
    return read_table(spark, sf_dir, "part").select("p_partkey", xsd.xml_to_json(doc, schema, "node", "urn:tree", recursion=8).alias("json"))


#: Built-in types of XML Schema with values that are of them, and behind the bar some that aren't.
TYPE_CASES = {
    "string": ["", " any "], "normalizedString": ["a b"], "token": ["a b"], "anyURI": ["http://a/b"], "boolean": ["true", "0", " 1 ", "|", "TRUE", "yes"], "decimal": ["-1.50", ".5", "7.", "|", "1e3", "."],
    "integer": ["+7", "-0", "12345678901234567890123456789012345678901", "|", "1.0", "x"], "long": ["-9223372036854775808", "|", "9223372036854775808"], "int": ["2147483647", "|", "2147483648"],
    "short": ["-32768", "|", "32768"], "byte": ["127", "|", "-129"], "nonNegativeInteger": ["0", "|", "-1"], "positiveInteger": ["1", "|", "0"], "nonPositiveInteger": ["0", "|", "1"], "negativeInteger": ["-1", "|", "0"],
    "unsignedLong": ["18446744073709551615", "|", "18446744073709551616"], "unsignedInt": ["4294967295", "|", "-1"], "unsignedShort": ["65535", "|", "65536"], "unsignedByte": ["255", "|", "256"],
    "float": ["1e-3", "-INF", "NaN", "|", "inf", "1e"], "double": ["12", "|", "1.2.3"], "date": ["2024-02-29", "2024-02-28+01:00", "|", "2023-02-29", "24-01-01"],
    "time": ["23:59:59.5", "24:00:00", "08:00:00Z", "|", "25:00:00", "8:00:00"], "dateTime": ["2024-01-31T10:00:00Z", "2024-01-31T10:00:00.123", "|", "2024-01-32T10:00:00", "2024-01-31"],
    "duration": ["P1Y2M", "PT0.5S", "-P3D", "|", "P", "P1YT", "1Y"], "gYear": ["2024", "|", "24"], "gYearMonth": ["2024-12", "|", "2024-13"], "gMonth": ["--07", "|", "07"], "gMonthDay": ["--02-29", "|", "--02-30"],
    "gDay": ["---31", "|", "---32"], "base64Binary": ["YWJj", "YWI=", "|", "YWI", "Y=Wj"], "hexBinary": ["0aFF", "|", "0a1"], "language": ["de-CH", "|", "much-too-long-parts-here-000000000"],
    "Name": ["a:b", "|", "1a"], "NCName": ["_a-1", "|", "a:b"], "ID": ["x.1", "|", "-x"], "IDREF": ["x", "|", "x y"], "QName": ["p:x", "|", "p:"], "NMTOKEN": ["-1a", "|", "a b"], "NMTOKENS": ["a -b", "|", "a,b"], "IDREFS": ["a b", "|", "a 1"],
}


def _type_cases() -> list[tuple[str, str, bool]]:
    return [(kind, text, "|" not in values[: i + 1]) for kind, values in TYPE_CASES.items() for i, text in enumerate(values) if text != "|"]


_CASES_SQL = ", ".join(f"({i}, '{kind}', {str(ok).lower()})" for i, (kind, _, ok) in enumerate(_type_cases()))


@query(f"SELECT event_id, kind, valid FROM events JOIN (VALUES {_CASES_SQL}) c(i, kind, valid) ON event_id % {len(_type_cases())} = i")
def xml_types(spark, sf_dir):
    """Values of every built-in simple type in documents, some of which aren't of it."""
    cases = _type_cases()
    parts = "".join(f'<xs:element name="{kind}" type="xs:{kind}" minOccurs="0"/>' for kind in TYPE_CASES)
    schema, _ = xsd.parse(f'<xs:schema xmlns:xs="{xsd.SPACE}"><xs:element name="t"><xs:complexType><xs:sequence>{parts}</xs:sequence></xs:complexType></xs:element></xs:schema>')
    at = (F.col("event_id") % len(cases) + 1).cast("int")
    docs = F.array(*(F.lit(f"<t><{kind}>{text}</{kind}></t>") for kind, text, _ in cases))
    value = xsd.xml_value(F.element_at(docs, at), schema, "t")
    rows = read_table(spark, sf_dir, "events").select("event_id", F.element_at(F.array(*(F.lit(kind) for kind, _, _ in cases)), at).alias("kind"), value.alias("value"))
    return rows.select("event_id", "kind", (F.size(schema.simple_errors(F.col("value"), "t")) == 0).alias("valid"))
