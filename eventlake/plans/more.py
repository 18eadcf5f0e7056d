"""Further queries: codecs at their edges, identifiers, character sets, folds in order, streams as views."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import identifiers, text
from ..operators import fold, log, runs
from ..sources import chunks, control, csv_codec, framing, json_codec, ranges, xsd
from ..streaming import materialize
from ..tables import new_path, read_table
from .registry import NAMESPACE, query
from .registry import entity_log as _log

# Identifiers and character sets

_DIGITS = "list_reduce(list_transform(regexp_extract_all({h}, '.'), lambda c: CAST(instr('0123456789abcdef', c) - 1 AS HUGEINT)), lambda a, b: a * 16 + b)"
_SIGNED = "CAST(CASE WHEN {n} >= 9223372036854775808 THEN {n} - 18446744073709551616 ELSE {n} END AS BIGINT)"


@query(f"""WITH h AS (SELECT DISTINCT user_id, sha1(unhex('{NAMESPACE.replace("-", "")}') || encode(CAST(user_id AS VARCHAR))) AS h FROM events),
u AS (SELECT user_id, h[1:8] || h[9:12] || '5' || h[14:16] || CASE WHEN h[17] IN ('0','4','8','c') THEN '8' WHEN h[17] IN ('1','5','9','d') THEN '9' WHEN h[17] IN ('2','6','a','e') THEN 'a' ELSE 'b' END || h[18:20] || h[21:32] AS d FROM h),
n AS (SELECT user_id, d, {_DIGITS.format(h="d[1:16]")} AS m, {_DIGITS.format(h="d[17:32]")} AS l FROM u)
SELECT user_id, {_SIGNED.format(n="m")} AS most, {_SIGNED.format(n="l")} AS least, d[1:8] || '-' || d[9:12] || '-' || d[13:16] || '-' || d[17:20] || '-' || d[21:32] AS back FROM n""")
def uuid_two_longs(spark, sf_dir):
    """UUIDs as two signed numbers and back."""
    made = read_table(spark, sf_dir, "events").select("user_id").distinct().withColumn("uuid", identifiers.uuid_v5(NAMESPACE, F.col("user_id").cast("string")))
    most, least = identifiers.uuid_longs(F.col("uuid"))
    return made.select("user_id", most.alias("most"), least.alias("least")).withColumn("back", identifiers.uuid_of_longs(F.col("most"), F.col("least")))


@query("""SELECT c_custkey, array_to_string(list_sort(list_distinct([lower(x) FOR x IN ['B' || lpad(CAST(c_custkey AS VARCHAR), 3, '0'), 'a1', 'b' || lpad(CAST(c_custkey AS VARCHAR), 3, '0')]])), ' ') AS ids FROM customer""")
def uuid_lists(spark, sf_dir):
    """Comma-separated identifiers as sorted sets: blanks, letter case and repeats don't count."""
    number = F.lpad(F.col("c_custkey").cast("string"), 3, "0")
    listed = F.concat(F.lit(" B"), number, F.lit(", a1 ,,b"), number, F.lit(","))
    return read_table(spark, sf_dir, "customer").select("c_custkey", F.array_join(identifiers.uuid_set(listed), " ").alias("ids"))


@query("""WITH {LOG}, p AS (SELECT persistence_id, max(timestamp_ms) FILTER (WHERE tag = 'signup') AS ms FROM log GROUP BY 1)
SELECT persistence_id, ms IS NULL AS none, COALESCE(ms, 0) AS epoch FROM p""")
def offset_epochs(spark, sf_dir):
    """Positions by time and back: without one there is none, which reads as 0."""
    last = _log(spark, sf_dir).groupBy("persistence_id").agg(F.max(F.when(F.col("tag") == "signup", F.col("timestamp_ms"))).alias("ms"))
    offset = identifiers.time_offset(F.coalesce("ms", F.lit(0)))
    return last.select("persistence_id", offset.isNull().alias("none"), identifiers.offset_epoch(offset).alias("epoch"))


@query("""SELECT event_id, CASE event_type WHEN 'click' THEN 'clicks' ELSE event_type || 'Event' END AS tag, base64(encode(event_type || '/' || user_id || '€')) AS entity FROM events""")
def event_tags(spark, sf_dir):
    """Tags of event types by configuration or name, and names of what a throttle holds back."""
    rows = read_table(spark, sf_dir, "events")
    kind = F.concat(F.when(F.col("event_id") % 2 == 0, "org.shop.").otherwise("org.shop.Outer$"), "event_type", F.lit("Event"))
    tag = identifiers.event_tag(kind, {"org.shop.clickEvent": "clicks", "org.shop.Outer$clickEvent": "clicks"})
    return rows.select("event_id", tag.alias("tag"), identifiers.throttle_entity(F.concat("event_type", F.lit("/"), "user_id", F.lit("€"))).alias("entity"))


@query(r"""SELECT doc_id, CASE WHEN NOT regexp_matches(text, '[^\x{0}-\x{FF}]') THEN CAST(length(text) AS BIGINT) END AS latin, text AS wide,
CAST(2 * length(text) + 2 * length(regexp_replace(text, '[^\x{10000}-\x{10FFFF}]', '', 'g')) AS BIGINT) AS wide_bytes, length(text) = 0 AS cut, length(text) > 0 AND NOT regexp_matches(text, '[^\x{0}-\x{7F}]') AS ascii FROM documents""")
def charset_variants(spark, sf_dir):
    """Texts as ISO-8859-1 and UTF-16 and back; what a set lacks, and bytes that end within a character, are nothing."""
    raw = F.col("text")
    latin, wide = text.try_encode(raw, "ISO-8859-1"), text.encode_strict(raw, "UTF-16LE")
    cut = wide.substr(F.lit(1), F.octet_length(wide) - 1)
    docs = read_table(spark, sf_dir, "documents")
    return docs.select(
        "doc_id", F.when(text.decode_strict(latin, "ISO-8859-1") == raw, F.octet_length(latin).cast("bigint")).alias("latin"), text.decode_strict(wide, "UTF-16LE").alias("wide"),
        F.octet_length(wide).cast("bigint").alias("wide_bytes"), (text.try_decode(cut, "UTF-16LE").isNotNull() | (F.octet_length(wide) == 0)).alias("cut"),
        (text.try_encode(raw, "US-ASCII").isNotNull() & (raw != "")).alias("ascii"),
    )


@query("""SELECT event_id, TRY_CAST(CASE WHEN event_id % 3 = 0 THEN event_type ELSE CAST(event_id AS VARCHAR) END AS BIGINT) AS value,
CASE WHEN event_id % 3 = 0 THEN 'Expecting bigint but was ' || event_type || ' at row ' || event_id END AS error, CASE WHEN event_id % 3 = 1 THEN event_type || '!' END AS required FROM events""")
def located_casts(spark, sf_dir):
    """Typed casts that tell where they fail, and texts that must be a full match."""
    rows = read_table(spark, sf_dir, "events")
    cell = F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(F.concat(F.lit(" "), F.col("event_id").cast("string")))
    value, error = text.parsed(cell, "bigint", F.concat(F.lit("row "), F.col("event_id").cast("string")))
    required = text.must_match(F.when(F.col("event_id") % 3 == 1, F.concat("event_type", F.lit("!"))), r"\w+!")
    return rows.select("event_id", value.alias("value"), error.alias("error"), required.alias("required"))


# Folds in order, chunks by time


@query("""WITH RECURSIVE {LOG}, r AS (SELECT persistence_id, sequence_nr, CASE WHEN tag = 'purchase' THEN CAST(floor(value) AS BIGINT) ELSE -CAST(floor(value / 4) AS BIGINT) END AS change FROM log),
f AS (SELECT persistence_id, sequence_nr, greatest(change, 0) AS balance, CAST(change < 0 AS BIGINT) AS empty FROM r WHERE sequence_nr = 1
  UNION ALL SELECT f.persistence_id, r.sequence_nr, greatest(f.balance + r.change, 0), f.empty + CAST(f.balance + r.change < 0 AS BIGINT) FROM f JOIN r ON r.persistence_id = f.persistence_id AND r.sequence_nr = f.sequence_nr + 1)
SELECT persistence_id, arg_max(balance, sequence_nr) AS balance, arg_max(empty, sequence_nr) AS empty FROM f GROUP BY 1""")
def fold_balance(spark, sf_dir):
    """A fold that order matters to: a balance that never falls below nothing, and how often it would have."""
    change = F.when(F.col("tag") == "purchase", F.floor("value")).otherwise(-F.floor(F.col("value") / 4))
    start = F.struct(F.lit(0).cast("bigint").alias("balance"), F.lit(0).cast("bigint").alias("empty"))
    step = lambda s, e: F.struct(F.greatest(s["balance"] + e["change"], F.lit(0)).alias("balance"), (s["empty"] + (s["balance"] + e["change"] < 0).cast("bigint")).alias("empty"))
    found = fold.fold_by_key(_log(spark, sf_dir).withColumn("change", change.cast("bigint")), fold.Fold(start, step), columns=("change",))
    return found.select("persistence_id", "state.balance", "state.empty")


@query("""WITH RECURSIVE {LOG}, r AS (SELECT persistence_id, sequence_nr, timestamp_ms AS t FROM log),
c AS (SELECT persistence_id, sequence_nr, t, t AS began, CAST(1 AS BIGINT) AS n, CAST(0 AS BIGINT) AS chunk FROM r WHERE sequence_nr = 1
  UNION ALL SELECT r.persistence_id, r.sequence_nr, r.t, CASE WHEN c.n >= 5 OR r.t - c.began >= 86400000 THEN r.t ELSE c.began END,
    CASE WHEN c.n >= 5 OR r.t - c.began >= 86400000 THEN 1 ELSE c.n + 1 END, c.chunk + CAST(c.n >= 5 OR r.t - c.began >= 86400000 AS BIGINT) FROM c JOIN r ON r.persistence_id = c.persistence_id AND r.sequence_nr = c.sequence_nr + 1)
SELECT persistence_id, chunk, CAST(count(*) AS BIGINT) AS n, min(t) AS first_ms FROM c GROUP BY 1, 2""")
def chunk_within(spark, sf_dir):
    """Each entity's events in chunks of five, or of a day."""
    found = runs.chunk_within(_log(spark, sf_dir), ["persistence_id"], ["timestamp_ms", "sequence_nr"], "timestamp_ms", 5, 86_400_000)
    return found.groupBy("persistence_id", "chunk").agg(F.count("*").alias("n"), F.min("timestamp_ms").alias("first_ms"))


@query("WITH {LOG} SELECT persistence_id, sequence_nr FROM log WHERE tag = 'view' AND timestamp_ms >= epoch_ms(TIMESTAMP '2024-01-20 12:00:00')")
def checked_slice(spark, sf_dir):
    """A slice that is looked at once before it is handed on: what can't be read fails at once."""
    return log.require_rows(log.events_by_tag(_log(spark, sf_dir), "view", "2024-01-20T12:00:00Z")).select("persistence_id", "sequence_nr")


# JSON and CSV at their edges


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN CAST(event_id AS BIGINT) WHEN 1 THEN CAST(event_id AS BIGINT) + 1 ELSE -1 END AS first, CASE event_id % 3 WHEN 1 THEN CAST(event_id AS BIGINT) * 2 + 3 ELSE 0 END AS total,
CASE event_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 0 ELSE 1 END AS both, event_id % 3 = 0 AS flag FROM events""")
def json_first_and_all(spark, sf_dir):
    """The first element that is something, all elements folded, every alternative that reads, booleans."""
    j, key, n = json_codec, F.col("event_id"), F.col("event_id") % 3
    doc = F.when(n == 0, F.concat(F.lit('{"id":'), key, F.lit(',"on":"true"}'))).when(n == 1, F.concat(F.lit('[{"x":1},{"id":'), key + 1, F.lit('},{"id":"'), key + 2, F.lit('"},5]'))).otherwise(F.lit('{"id":"-1","on":"TRUE"}'))
    item = j.Object({"id": j.Scalar("bigint")})
    docs = read_table(spark, sf_dir, "events").select("event_id", doc.alias("doc"))
    many, _ = j.decoded(F.col("doc"), j.Each(item))
    total = fold.Fold(F.lit(0).cast("bigint"), lambda s, e: s + e["id"]).over(F.coalesce(many, F.array().cast("array<struct<id:bigint>>")))
    flag, _ = j.decoded(F.col("doc"), j.Object({"on": j.Scalar("boolean")}))
    second = j.Object({"id": j.Scalar("bigint"), "on": j.Scalar("boolean").map(lambda v: F.when(v, v))}).map(lambda v: v["id"])
    both = F.size(j.combined(F.col("doc"), item.map(lambda v: v["id"]), second))
    return docs.select("event_id", j.first_of(F.col("doc"), item)["id"].alias("first"), total.alias("total"), both.alias("both"), F.coalesce(flag["on"], F.lit(False)).alias("flag"))


@query("""SELECT c_custkey, CAST(c_custkey AS BIGINT) AS id, CASE WHEN c_custkey % 3 = 1 THEN c_mktsegment END AS segment, CASE WHEN c_custkey % 3 = 2 THEN 'a cell of name is longer than 20' END AS error FROM customer""")
def csv_headers(spark, sf_dir):
    """Of two headers with one name the first counts, short records and a byte order mark are read, long cells are told."""
    header = ["id", "segment", "id", "segment", "name"]
    key = F.col("c_custkey").cast("string")
    row = F.concat(F.lit("﻿"), key, F.when(F.col("c_custkey") % 3 == 0, "").when(F.col("c_custkey") % 3 == 1, F.concat(F.lit(';"'), "c_mktsegment", F.lit('";0;other;'), key)).otherwise(F.concat(F.lit(";;;;"), F.repeat(key, 21))))
    rows = read_table(spark, sf_dir, "customer").select(row.alias("line"))
    back = csv_codec.decode(rows, "line", header, {"id": "bigint", "segment": "string", "name": "string"}, ("segment", "name"), csv_codec.CsvSettings(longest_cell=20))
    return back.select(F.col("id").cast("int").alias("c_custkey"), "id", "segment", "error")


@query("""SELECT '"p_partkey";"na""me"' AS line UNION ALL SELECT '"' || p_partkey || '";"' || replace(p_name, '"', '""') || '"' FROM part""")
def csv_written(spark, sf_dir):
    """A table as CSV files that are one document: one header, then every row."""
    path = new_path(spark, "csv")
    csv_codec.write_csv(read_table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias('na"me')), path, each_file=False)
    return spark.read.text(path).withColumnRenamed("value", "line")


LIBRARY = {
    "main": """<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema" xmlns:c="urn:common" xmlns="urn:main" targetNamespace="urn:main"><xs:import namespace="urn:common" schemaLocation="common"/><xs:include schemaLocation="shared"/>
<xs:element name="nation" type="Nation"/><xs:complexType name="Nation"><xs:complexContent><xs:extension base="c:Named"><xs:sequence><xs:element name="region" type="Region" maxOccurs="unbounded"/></xs:sequence><xs:attribute name="key" type="xs:int"/></xs:extension></xs:complexContent></xs:complexType></xs:schema>""",
    "shared": """<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:include schemaLocation="shared"/><xs:complexType name="Region"><xs:simpleContent><xs:extension base="xs:string"><xs:attribute name="key"/></xs:extension></xs:simpleContent></xs:complexType></xs:schema>""",
    "common": """<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema" targetNamespace="urn:common"><xs:import namespace="urn:main" schemaLocation="main"/><xs:complexType name="Named"><xs:sequence><xs:element name="name" type="xs:string"/></xs:sequence><xs:attribute name="key"/></xs:complexType></xs:schema>""",
}


@query("""SELECT n_nationkey, '{"name":"' || n_name || '","region":[{"key":"' || n_regionkey || '","value":"' || r_name || '"},{"key":"x","value":" last"}],"key":"' || n_nationkey || '"}' AS json FROM nation JOIN region ON r_regionkey = n_regionkey""")
def xml_loaded_schema(spark, sf_dir):
    """Documents by a schema of three parts that import and include each other, one of them without a namespace; a derived type's own attribute replaces its base's."""
    schema = xsd.load("main", LIBRARY.__getitem__)
    nations = read_table(spark, sf_dir, "nation").join(read_table(spark, sf_dir, "region").withColumnsRenamed({"r_regionkey": "n_regionkey"}), "n_regionkey")
    doc = F.concat(F.lit('<nation key="'), "n_nationkey", F.lit('"><name>'), "n_name", F.lit('</name><region key="'), "n_regionkey", F.lit('">'), "r_name", F.lit('</region><gone/><region key="x"> last</region></nation>'))
    return nations.select("n_nationkey", xsd.xml_to_json(doc, schema, "nation", "urn:main").alias("json"))


# Streams as views


def _stored_parts(spark, sf_dir, *conditions) -> tuple[str, str]:
    """The log in files of one part each, as a stream finds it; the DDL of its columns."""
    path = new_path(spark, "incoming")
    events = _log(spark, sf_dir).select("persistence_id", "sequence_nr", "timestamp_ms", "tag", "event")
    for n, condition in enumerate(conditions):
        events.where(condition).write.parquet(f"{path}/part={n}")
    return path, "persistence_id string, sequence_nr long, timestamp_ms long, tag string, event string, part int"


@query("WITH {LOG} SELECT persistence_id, max(sequence_nr) AS sequence_nr, arg_max(tag, sequence_nr) AS tag FROM log GROUP BY 1")
def materialized_view(spark, sf_dir):
    """Each entity's latest event in a control table that a stream updates, part by part, some events coming twice; then one reimport of a few entities from the start."""
    path, kind = _stored_parts(spark, sf_dir, "sequence_nr % 2 = 0", "sequence_nr % 2 = 1", "sequence_nr % 5 = 0")
    view = control.ControlTable(spark, new_path(spark, "view"), {"persistence_id": "string"}, {"sequence_nr": "long", "tag": "string", "latest": "struct<nr:bigint,tag:string>"}, {"sequence_nr": control.largest, "latest": control.largest}, 16)
    apply = view.apply(lambda batch: batch.withColumn("latest", F.struct(F.col("sequence_nr").alias("nr"), "tag")))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 4).parquet(path)
    materialize.materialize(stream.drop("part"), apply, new_path(spark, "view-checkpoint")).awaitTermination()
    events = _log(spark, sf_dir)
    materialize.reimport(events, events.where("tag = 'error'").select("persistence_id"), apply, 1 << 45)
    return view.read().select("persistence_id", "sequence_nr", "latest.tag")


@query("WITH {LOG} SELECT persistence_id, sequence_nr, timestamp_ms FROM log WHERE tag = 'signup' AND sequence_nr % 2 = 0")
def backup_streamed(spark, sf_dir):
    """A tag out of a backup that a stream made and went on with after a stop."""
    path, kind = _stored_parts(spark, sf_dir, "sequence_nr % 4 = 0")
    target, checkpoint = new_path(spark, "backup"), new_path(spark, "backup-checkpoint")
    run = lambda: chunks.backup_stream(spark.readStream.schema(kind).parquet(path).drop("part"), target, checkpoint, 500).awaitTermination()
    run()
    _log(spark, sf_dir).where("sequence_nr % 4 = 2").select("persistence_id", "sequence_nr", "timestamp_ms", "tag", "event").write.parquet(f"{path}/part=1")
    run()
    back = framing.decode_frames(chunks.restore(spark, target, "signup"), "message")
    return back.select("persistence_id", "sequence_nr", "timestamp_ms")


@query("WITH {LOG} SELECT persistence_id, sequence_nr, CAST(count(*) OVER (PARTITION BY timestamp_ms) AS BIGINT) AS n FROM log WHERE timestamp_ms >= epoch_ms(TIMESTAMP '2024-01-10') AND timestamp_ms < epoch_ms(TIMESTAMP '2024-01-12')")
def replayed_slice(spark, sf_dir):
    """A bounded slice replayed twice into a folder of batches: each event once, with how many share its time."""
    path = new_path(spark, "replay")
    apply = materialize.upsert_parquet(spark, path, ["persistence_id", "sequence_nr"])
    for _ in range(2):
        materialize.replay(_log(spark, sf_dir).select("persistence_id", "sequence_nr", "timestamp_ms"), apply, 1_704_844_800_000, 1_705_017_600_000)
    same = Window.partitionBy("timestamp_ms")
    return materialize.merged(spark, path, ["persistence_id", "sequence_nr"]).select("persistence_id", "sequence_nr", F.count("*").over(same).alias("n"))


@query("WITH {LOG} SELECT persistence_id, sequence_nr, timestamp_ms, event FROM log")
def framing_ranges(spark, sf_dir):
    """The log in files of messages, read again in pieces of 4,096 bytes that know nothing of where a message begins; a message of one line feed follows up to 500 of an entity, so that no file is held whole to be written."""
    path = new_path(spark, "messages")
    part = F.floor(F.col("sequence_nr") / 500).alias("part")
    frames = _log(spark, sf_dir).select((F.col("persistence_id").cast("int") % 5).alias("file"), "persistence_id", part, "sequence_nr", framing.envelope_frame("persistence_id", "sequence_nr", "timestamp_ms", "event").alias("content"))
    lines = framing.concatenated(frames, ["file", "persistence_id", "part"], "sequence_nr").select("file", F.concat("content", F.lit(b"\x01")).cast("string").alias("value"))
    lines.write.partitionBy("file").option("encoding", "ISO-8859-1").option("lineSep", "\n").text(path)
    back = framing.decode_messages(ranges.messages(spark, path, 4096).where(F.col("message") != F.lit(b"\n")))
    return back.select("persistence_id", "sequence_nr", "timestamp_ms", F.col("event").cast("string").alias("event"))
