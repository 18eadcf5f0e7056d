"""Files of messages read in pieces: the same messages wherever the cuts fall."""

import numpy as np
import pytest

from eventlake.sources import framing, ranges


def plain(data):
    """(place, message) of each message, one after the other."""
    out, at = [], 0
    for m in framing.frames(data):
        out.append((at, m))
        at += len(framing.varint(len(m))) + len(m)
    return out


def sample(seed, n, longest, alphabet=256):
    rng = np.random.default_rng(seed)
    sizes = rng.choice([0, 1, 2, 5, 20, 126, 127, 128, 130, longest], n)
    return b"".join(framing.varint(int(k)) + rng.integers(0, alphabet, int(k), dtype=np.uint8).tobytes() for k in sizes)


def test_steps_and_exits():
    data = sample(1, 60, 300)
    array = np.frombuffer(data, np.uint8)
    places = [p for p, _ in plain(data)] + [len(data)]
    to = ranges.steps(array, len(data), len(data))
    assert [int(to[p]) for p in places[:-1]] == places[1:]
    for n in range(1, len(data), 7):
        assert int(ranges.exits(array[: n + 10], n, len(data))[0]) == next(p for p in places if p >= n)
    assert ranges.steps(np.full(10, 255, np.uint8), 1, 10**9).tolist() == [ranges.DEAD]
    assert ranges.steps(np.frombuffer(b"\x82\x80\x80\x80\x80\x80\x80\x80\x80\x00ab", np.uint8), 1, 12).tolist() == [12]


@pytest.mark.parametrize(("size", "block"), [(10, 2000), (64, 900), (1 << 20, 100_000)])
def test_files_in_pieces(spark, tmp_path, size, block):
    files = {"a": sample(2, 40, 700), "b": b"", "c": b"\xef\x01" + b"x" * 0xEF, "d": framing.varint(5000) + b"\n" * 5000, "e": b"\x00" * 500, "f": b"\x01\n\x00\x02\n\n", "g": sample(3, 30, 40, 14)}
    (tmp_path / "in").mkdir()
    for name, data in files.items():
        (tmp_path / "in" / name).write_bytes(data)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", block)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)
        got = [(r.file.rpartition("/")[2], r.at, bytes(r.message)) for r in ranges.messages(spark, f"{tmp_path}/in", size).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted(got) == sorted((name, at, m) for name, data in files.items() for at, m in plain(data))


def test_byte_order_marks(spark, tmp_path):
    """A file whose first bytes look like a mark, which the reader leaves out."""
    n = 0x6F | 0x3B << 7 | 0x3F << 14
    data = b"\xef\xbb\xbf\x00" + b"z" * n + b"\x02ok"
    assert plain(data)[0] == (0, b"z" * n)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "m").write_bytes(data)
    assert sorted((r.at, len(r.message)) for r in ranges.messages(spark, f"{tmp_path}/in", 100_000).collect()) == [(0, n), (4 + n, 2)]


def test_broken_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "cut").write_bytes(framing.varint(5) + b"abcde" + framing.varint(9) + b"short")
    with pytest.raises(Exception, match="cut off"):
        ranges.messages(spark, f"{tmp_path}/in", 10).collect()
    with pytest.raises(ValueError, match="bytes at least"):
        ranges.messages(spark, f"{tmp_path}/in", 5)


def log_file(seed, n):
    """Envelopes with times of today: their bytes look like the starts of long messages."""
    rng = np.random.default_rng(seed)
    made = [framing.encode_envelope(str(int(p)), i, 1_704_067_200_000 + int(t), b'{"k": %d}' % p) for i, (p, t) in enumerate(rng.integers(0, 10**9, (n, 2)))]
    return b"".join(framing.varint(len(m)) + m for m in made)


@pytest.mark.parametrize(("guesses", "passes"), [(8, 1), (1, 2)])
def test_entries_followed_dont_grow_with_the_messages(spark, tmp_path, monkeypatch, guesses, passes):
    """A few a piece are followed, and one is kept; a file that leaves these is followed through all."""
    files = {"a": log_file(5, 4000), **({"b": sample(6, 60, 3000)} if passes > 1 else {})}
    (tmp_path / "in").mkdir()
    for name, data in files.items():
        (tmp_path / "in" / name).write_bytes(data)
    tables, written = [], ranges.written

    def counted(df, name):
        out = written(df, name)
        tables.append((name, out.count()))
        return out

    monkeypatch.setattr(ranges, "written", counted)
    monkeypatch.setattr(ranges, "GUESSES", guesses, raising=False)
    got = [(r.file.rpartition("/")[2], r.at, bytes(r.message)) for r in ranges.messages(spark, f"{tmp_path}/in", 512).collect()]
    assert sorted(got) == sorted((name, at, m) for name, data in files.items() for at, m in plain(data))
    entries, pieces = ([n for name, n in tables if name == which] for which in ("entries", "file-pieces"))
    assert len(entries) == passes and max(entries) <= sum(pieces)


def test_framing_ranges_writes_no_file_as_one_value(spark, tmp_path, monkeypatch):
    """An entity of many events: its messages are written in bounded groups, and all come back."""
    from eventlake.plans import catalogue

    rows = spark.range(3000).selectExpr("id AS event_id", "timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id) AS ts", "7L AS user_id", "'view' AS event_type", "1.5D AS value", "'{}' AS props")
    rows.write.parquet(f"{tmp_path}/events.parquet")
    longest, concatenated = [], framing.concatenated

    def measured(*args):
        out = concatenated(*args)
        longest.append(out.selectExpr("max(octet_length(content))").first()[0])
        return out

    monkeypatch.setattr(framing, "concatenated", measured)
    got = catalogue.QUERIES["framing_ranges"](spark, str(tmp_path)).collect()
    assert sorted((r.persistence_id, r.sequence_nr) for r in got) == [("7", n) for n in range(1, 3001)]
    assert max(longest) <= 500 * 40
