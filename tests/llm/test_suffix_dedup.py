"""Repeated byte strings against brute force over all 50-byte windows."""

import hashlib
import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from plumetrics.llm import suffix_dedup
from plumetrics.llm.common import table

SCHEMA = "doc_id long, text string, n_bytes int, key string"


def brute(docs, length=50):
    """docs: (id, text) -> rows of the operator."""
    order = sorted(docs, key=lambda d: (d[0] is None, d[0] or 0))
    first = {}
    for i, text in order:
        body = (text or "").encode()
        for p in range(len(body) - length + 1):
            first.setdefault(body[p: p + length], i)
    rows = []
    for i, text in docs:
        body = (text or "").encode()
        gone = np.zeros(len(body) + 1, bool)
        for p in range(len(body) - length + 1):
            own = first[body[p: p + length]]
            if own is not None and (i is None or own < i):
                gone[p: p + length] = True
        runs = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        kept = bytes(b for b, g in zip(body, gone) if not g)
        rows.append((i, len(body), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(rows, key=repr)


def noise(rnd, n, letters="ab cdé\n"):
    return "".join(rnd.choice(letters) for _ in range(n))


def corpus(seed):
    rnd = random.Random(seed)
    shared = [noise(rnd, n) for n in (49, 50, 51, 70, 200, 1000)]
    docs = []
    for i in range(60):
        parts = [noise(rnd, rnd.randint(0, 120)) for _ in range(3)]
        docs.append((i, parts[0] + rnd.choice(shared) + parts[1] + rnd.choice(shared)[: rnd.randint(30, 400)] + parts[2]))
    docs += [(100 + i, docs[rnd.randint(0, 59)][1]) for i in range(10)]
    body = docs[3][1]
    docs += [(200 + i, body[:i * 7] + "#" + body[i * 7:]) for i in range(20)]
    docs += [(300, ""), (301, None), (302, "x" * 3000), (303, "x" * 70), (304, "ab" * 900), (305, "ab" * 40),
             (306, "x" * 49), (307, shared[0]), (5, docs[5][1]), (5, docs[6][1]), (None, docs[7][1]), (None, noise(rnd, 90)),
             (310, "\0" * 120), (311, "q\0" * 60 + "\0" * 60)]
    rnd.shuffle(docs)
    return docs


@pytest.mark.parametrize("seed, bucket, hot", [(1, 1 << 26, 1 << 16), (2, 2000, 1 << 16), (3, 20000, 0), (4, 2000, 2)])
def test_brute_force(frame, rows, seed, bucket, hot):
    docs = corpus(seed)
    df = frame([(i, t, 0, "") for i, t in docs], SCHEMA).repartition(5)
    got = suffix_dedup.deduplicate(df, bucket_text=bucket, hot_texts=hot, with_bytes=False)
    assert rows(got) == brute(docs)


def batch_of(docs):
    return pa.RecordBatch.from_pydict({"text": [t for _, t in docs]})


def marked(docs, buckets, hot_texts=1 << 16):
    """(bytes that list the anchors, rows of the repeated anchors, rows of the spans) of one portion in plain numpy."""
    listed = list(suffix_dedup.list_anchors(buckets, 50, 20)(iter([batch_of(docs)])))
    n_bytes = sum(len(v.as_py()) for batch in listed for c in batch.columns[1:] for v in c)
    found = pd.concat([suffix_dedup.repeated_anchors(hot_texts)(b.to_pandas()) for b in listed])
    by_key = found.groupby("key")["hash"].apply(list)
    keys = [suffix_dedup.text_key((t or "").encode()) for _, t in docs]
    keys = np.array(keys, np.uint64).view(np.int64)
    batch = pa.RecordBatch.from_pydict({"doc": np.arange(len(docs)), "key": keys, "text": [t for _, t in docs],
                                        "hashes": pa.array([by_key.get(k, []) for k in keys], pa.list_(pa.int64()))})
    sent = list(suffix_dedup.send_contexts(buckets, 50, 20)(iter([batch])))
    spans = pd.concat([suffix_dedup.mark(50, 20)(b.to_pandas()) for b in sent])
    return n_bytes, len(found), spans, [len(b.column("windows")[0].as_py()) for b in sent]


def test_work_does_not_grow_with_buckets():
    docs = [(i, t) for i, t in enumerate(dict.fromkeys(t for _, t in corpus(6) if t))]
    bytes4, anchors4, spans4, _ = marked(docs, 4)
    bytes64, anchors64, spans64, _ = marked(docs, 64)
    assert bytes64 <= 1.2 * bytes4 and anchors64 == anchors4 and len(spans64) <= 1.2 * len(spans4)
    assert len(spans4) > 100


def test_hot_anchor_is_divided():
    """One anchor in many different surroundings goes to many buckets."""
    rnd = random.Random(7)
    common = min((noise(rnd, 20, "abcdefgh") for _ in range(2000)), key=lambda x: int(suffix_dedup.rolling(np.frombuffer(x.encode(), np.uint8), 20)[0]))
    docs = [(i, noise(rnd, 31, "abcdefgh") + common + noise(rnd, 31, "abcdefgh")) for i in range(600)]
    whole, divided = (max(marked(docs, 64, hot)[3]) for hot in (1 << 16, 100))
    assert whole >= 500 and divided < whole / 4


def test_long_text(frame, rows):
    rnd = random.Random(8)
    body = noise(rnd, 5_000_000)
    docs = [(1, body), (2, "x" + body[1_000_000:1_000_400] + "y"), (3, body[:2_000_000] + "z" * 500)]
    got = {r["doc_id"]: r for r in suffix_dedup.deduplicate(frame([(i, t, 0, "") for i, t in docs], SCHEMA), with_bytes=False).collect()}
    assert got[1]["n_removed"] == 0
    assert got[2]["n_removed"] == len(body[1_000_000:1_000_400].encode()) and got[2]["n_spans"] == 1
    assert got[3]["n_removed"] == len(body[:2_000_000].encode()) and got[3]["n_spans"] == 1


def test_small_chunks(monkeypatch):
    """The interval expansion gives the same whatever the chunks."""
    rnd = random.Random(5)
    words = [noise(rnd, 60) for _ in range(30)]
    texts = [rnd.choice(words)[rnd.randint(0, 5):] + rnd.choice(words) for _ in range(60)]
    parts = [t[:80].encode() for t in texts]
    least = np.arange(len(parts))
    got = suffix_dedup.removed_windows(parts, least, 50, 100)
    seen = {}
    for i, p in enumerate(parts):
        for k in range(len(p) - 49):
            seen.setdefault(p[k: k + 50], i)
    for i, p in enumerate(parts):
        assert got[i].tolist() == [seen[p[k: k + 50]] < i for k in range(len(p) - 49)]


def test_intervals_are_prefix_classes():
    data = np.array([*b"banana", 0, *b"ananas", 0, *b"banana", 0], np.int16)
    ends = np.flatnonzero(data == 0)
    for length in (1, 2, 3, 5, 6):
        order, begins = suffix_dedup.equal_prefixes(data, ends, length, 14)
        label = np.cumsum(begins)
        prefix = {}
        for row, p in enumerate(order.tolist()):
            end = int(ends[np.searchsorted(ends, p)])
            name = bytes(data[p: p + length].astype(np.uint8)) if p + length <= end else ("short", p)
            prefix.setdefault(name, set()).add(label[row])
        assert all(len(v) == 1 for v in prefix.values()) and len(prefix) == label[-1]


def test_empty(frame, rows):
    assert rows(suffix_dedup.deduplicate(frame([], SCHEMA))) == []


def test_kept_bytes(frame):
    text = "abcdefghij" * 6
    got = {r["doc_id"]: bytes(r["kept"]) for r in suffix_dedup.deduplicate(
        frame([(1, text, 0, ""), (2, "<" + text + ">", 0, "")], SCHEMA)).collect()}
    assert got == {1: text.encode(), 2: b"<>"}


def test_whole_table(spark, rows, sf_dir):
    docs = [tuple(r) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    from plumetrics.llm.queries import QUERIES
    assert rows(QUERIES["op3_suffix_dedup"](spark, sf_dir)) == brute(docs)
