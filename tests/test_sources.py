import struct

import pytest

from millrace.operators.versioned import live
from millrace.sources.segments import FOOTER, MAGIC, decode_log, encode_record, encode_varint, read_log, read_tables


def put(path, name, data):
    (path / name).write_bytes(data)


def test_a_store_recovers_from_its_logs(spark, tmp_path):
    first = b"".join(encode_record(f"k{i}".encode(), f"v{i}".encode()) for i in range(500))
    second = b"".join(encode_record(f"k{i}".encode(), None) for i in range(0, 500, 2))
    put(tmp_path, "0000000001.data", first)
    put(tmp_path, "0000000002.data", second + encode_record(b"torn", b"x" * 99)[:50])
    records = read_log(spark, str(tmp_path), "*.data")
    assert records.count() == 750
    assert {bytes(r.key) for r in live(records, "key", ["file", "offset"]).collect()} == {f"k{i}".encode() for i in range(1, 500, 2)}


@pytest.mark.parametrize("case", ["flipped in the newest", "torn in a sealed log"])
def test_damage_is_refused(spark, tmp_path, case):
    good = encode_record(b"a", b"1") + encode_record(b"b", b"2")
    flipped = good[:-1] + bytes([good[-1] ^ 1])
    put(tmp_path, "1", good[:-1] if case.startswith("torn") else good)
    put(tmp_path, "2", good if case.startswith("torn") else flipped)
    with pytest.raises(Exception, match="torn record|damaged record"):
        read_log(spark, str(tmp_path)).count()


def test_edges_of_the_log_format():
    assert list(decode_log(b"", True)) == []
    assert [r[1:] for r in decode_log(encode_record(b"", b"") + encode_record(b"k", None), False)] == [(b"", b"", False), (b"k", None, True)]
    assert list(decode_log(b"\xff" * 40, True)) == []


def test_sorted_tables(spark, tmp_path):
    rows = [(f"k{i:04d}".encode(), None if i % 7 == 0 else b"v" * (i % 300)) for i in range(400)]
    data = b"".join(encode_varint(len(k)) + k + encode_varint(len(v or b"")) + (v or b"") + bytes([v is None]) for k, v in rows)
    put(tmp_path, "1.sst", data + struct.pack(FOOTER, MAGIC, len(data), 0, len(data), 0, len(rows)))
    got = read_tables(spark, str(tmp_path), "*.sst").orderBy("offset").collect()
    assert [(bytes(r.key), None if r.value is None else bytes(r.value)) for r in got] == rows
    put(tmp_path, "2.sst", data + struct.pack(FOOTER, MAGIC, len(data), 0, len(data), 0, 1))
    with pytest.raises(Exception, match="footer"):
        read_tables(spark, str(tmp_path), "2.sst").count()
