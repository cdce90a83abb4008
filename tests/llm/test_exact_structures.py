"""Decontamination, the Merkle manifest and the prefix trie against brute force, with odd rows."""

import hashlib
import random
import re
import zlib

import duckdb
import pytest

from plumetrics.llm import decontamination, merkle, prefix_trie
from plumetrics.llm.common import fold
from plumetrics.llm.queries import ORACLES, QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def words(text):
    return WORD.findall((text or "").translate(LOWER))


# Decontamination

def brute_hits(text, items, width):
    """(words, hit positions, ids, places) of a text; items are (id, text)."""
    own, hit, ids, places = words(text), set(), set(), set()
    for item, body in items:
        w = words(body)
        n = min(len(w), width)
        for part in {tuple(w[i: i + n]) for i in range(len(w) - n + 1)} if w else ():
            for i in range(len(own) - n + 1):
                if tuple(own[i: i + n]) == part:
                    hit |= set(range(i, i + n))
                    ids.add("" if item is None else str(item))
                    places.add((i, i + n))
    return len(own), len(hit), sorted(ids), sorted(places)


ITEMS = [(1, "The quick brown fox jumps over the lazy dog and then it sleeps"), (2, "two words"), (10, "Übung-macht den Meister"),
         (3, ""), (4, None), (None, "an item without id"), (2, "also of item two"), (5, "a a a a a a a a a a a a"),
         (6, "one"), (7, "jumps over the lazy dog and then it sleeps"), (7, "jumps over the lazy dog and then it sleeps"),
         (8, "the end of the end of the end of the end of it")]


def hit_docs():
    rnd = random.Random(5)
    vocabulary = sorted({w for _, t in ITEMS for w in words(t)}) + ["other", "more"]
    made = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(0, 60))) for _ in range(40)]
    whole = [t for _, t in ITEMS if t]
    made += [f"{rnd.choice(vocabulary)}, {rnd.choice(whole).upper()}! {rnd.choice(whole)}" for _ in range(20)]
    made += ["", None, " \n.,", "one", "ONE", "a " * 50, "ÜBUNG macht den meister", "übung macht den meister", "x " * 30000 + ITEMS[0][1] + " y" * 30000]
    return [(i, t) for i, t in enumerate(made)] + [(3, "two words"), (3, "two words"), (None, "two words")]


@pytest.mark.parametrize("width, shingle, pass_bytes", [(10, 3, 1 << 20), (10, 3, 100), (4, 2, 1 << 20), (3, 1, 300), (5, 8, 1 << 20)])
def test_contamination(frame, width, shingle, pass_bytes):
    docs = frame([(i, t, "p", 1) for i, t in hit_docs()], "doc_id long, text string, plain string, row int").repartition(3)
    items = frame([(i, t, "q") for i, t in ITEMS], "item_id long, text string, words string")
    got = decontamination.contaminated(docs, items, width, shingle, pass_bytes=pass_bytes).collect()
    found = [(r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"]), tuple((p["start"], p["end"]) for p in r["places"])) for r in got]
    want = []
    for i, t in hit_docs():
        n, hit, ids, places = brute_hits(t, ITEMS, width)
        want.append((i, n, hit, tuple(ids), tuple(places)))
    assert sorted(found, key=repr) == sorted(want, key=repr)


def test_contamination_of_nothing(frame):
    docs, items = "doc_id long, text string", "item_id long, text string"
    assert decontamination.contaminated(frame([], docs), frame(ITEMS, items)).count() == 0
    for none in ([], [(1, None), (2, "  ")]):
        got = decontamination.contaminated(frame([(1, "some words")], docs), frame(none, items)).first()
        assert (got["n_words"], got["n_hit"], got["items"], got["places"]) == (2, 0, [], [])


def test_contamination_runs_no_python(frame):
    got = decontamination.contaminated(frame(hit_docs(), "doc_id long, text string"), frame(ITEMS, "item_id long, text string"))
    assert "Python" not in got._jdf.queryExecution().toString() and "Arrow" not in got._jdf.queryExecution().toString()


# Merkle manifest

def brute_leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def brute_tree(nodes, fan):
    """(top, paths): for each node the runs above it."""
    level, at, paths = nodes, list(range(len(nodes))), [[] for _ in nodes]
    while len(level) > 1:
        for i, p in enumerate(at):
            begin = p // fan * fan
            paths[i].append((p - begin, level[begin: begin + fan]))
            at[i] = p // fan
        level = [sha("".join(level[i: i + fan])) for i in range(0, len(level), fan)]
    return level[0], paths


def brute_manifest(rows, fan):
    """rows: (doc_id, source, lang, n_chars, text)."""
    trees = {}
    for row in rows:
        trees.setdefault(row[2], []).append((row, brute_leaf(row)))
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    for lang in langs:
        trees[lang].sort(key=lambda x: ((x[0][0] is not None, x[0][0] or 0), x[1]))
    tops = [brute_tree([d for _, d in trees[lang]], fan) for lang in langs]
    root, above = brute_tree([top for top, _ in tops], fan)
    out = []
    for k, lang in enumerate(langs):
        for (row, digest), path in zip(trees[lang], tops[k][1]):
            whole = path + above[k]
            proof = sha("".join(d for own, run in whole for i, d in enumerate(run) if i != own))
            tampered = zlib.crc32(str(row[0]).encode() if row[0] is not None else b"") % 3 == 0
            now = brute_leaf((*row[:4], row[4] and row[4].translate(LOWER))) if tampered else digest
            for own, run in whole:
                now = sha("".join([*run[:own], now, *run[own + 1:]]))
            out.append((row[0], digest, tops[k][0], root, proof, now, now == root))
    return sorted(out, key=repr)


LEAVES = "doc_id long, source string, lang string, n_chars long, text string, place long, tree string, digest string"


def manifest_rows():
    rnd = random.Random(3)
    rows = [(i, rnd.choice(["a", "b", None]), rnd.choices(["en", "de", "fr", "é"], [30, 6, 3, 1])[0], i * 7, rnd.choice(["Text", "all low", "", None, "ÄÖ Z"]))
            for i in range(150)]
    rows += [(500, None, None, None, None), (501, "s", "alone", 1, "ONE"), (None, "s", "en", 1, "no id"), (None, "s", "en", 1, "no id"),
             (7, "s", "en", 9, "again"), ((1 << 60) + 1, "s", "en", 2, "Big"), (502, "s", "", 0, "x" * 200000)]
    return rows + [rows[1]]


@pytest.mark.parametrize("fan, levels", [(8, 4), (2, 1), (2, 3), (8, 1)])
def test_manifest(frame, rows, fan, levels):
    docs = frame([(*r, 1, "x", "y") for r in manifest_rows()], LEAVES).repartition(3)
    got = merkle.manifest(docs, changed=fold("doc_id", 3) == 0, fan=fan, levels=levels)
    assert rows(got.drop("proof")) == brute_manifest(manifest_rows(), fan)
    assert got.filter("folded_root = root").count() == got.filter("verified").count() > 0


def test_manifest_proofs_fold(frame):
    docs = frame([(*r, 1, "x", "y") for r in manifest_rows()], LEAVES)
    for r in merkle.manifest(docs, fan=4, levels=2).collect():
        assert r["verified"] and merkle.fold_up(r["leaf"], merkle.parsed(r["proof"])) == r["root"]


def test_manifest_few_rows(frame, rows):
    assert merkle.manifest(frame([], LEAVES)).count() == 0
    one = merkle.manifest(frame([(1, "s", "en", 1, "A", 0, "", "")], LEAVES)).first()
    assert one["leaf"] == one["subroot"] == one["root"] == one["folded_root"] and one["proof_sha256"] == sha("")


# Prefix trie

def brute_trie(turns, group=100, heads=6):
    """turns: (conv_id, turn, role, text)."""
    convs = {}
    for c, turn, role, text in turns:
        if c is not None:
            convs.setdefault(c, []).append((turn, role or "", text or ""))
    name = lambda t: hashlib.sha256(f"{len(t[1].encode())}:{t[1]}{t[2]}".encode()).digest()
    for own in convs.values():
        own.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), name(t)[:16]))
    made = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % heads
        first = c - (c % group if c >= 0 else -(-c % group))
        made[c] = [t[1:] for t in convs.get(first, [])[:h] + own[h:]]
    nodes = {}
    for c, path in made.items():
        for d in range(len(path) + 1):
            nodes.setdefault(tuple(path[:d]), []).append(c)
    kids = {}
    for path in nodes:
        if path:
            kids.setdefault(path[:-1], []).append(path)
    sums = {}
    for path in sorted(nodes, key=len, reverse=True):
        below = kids.get(path, [])
        sums[path] = (sum(sums[k][0] for k in below) or (0 if below else 1),
                      sum(sums[k][1] for k in below) + (len(nodes[path]) - 1) * (len(path[-1][1]) if path else 0))
    return sorted(((min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), *sums[p],
                    sha(",".join(str(c) for c in sorted(m) if len(made[c]) == len(p)))) for p, m in nodes.items()), key=repr)


TURNS = "conv_id long, turn long, role string, text string, depth int, id string, size int"


def talk(seed):
    rnd = random.Random(seed)
    line = lambda: (rnd.choice(["user", "bot", None]), rnd.choice(["hi", "Hello there", "é", "", None, "what"]))
    turns = []
    for c in [*range(-3, 40), *range(98, 130), 200, 301, 302]:
        turns += [(c, t, *line()) for t in range(rnd.choice([1, 2, 3, 5, 8, 9, 17]))]
    same = [line() for _ in range(60)]
    turns += [(c, t, *x) for c in (400, 401, 402, 403, 455) for t, x in enumerate(same[: 20 if c == 402 else 60])]
    turns += [(5, None, "user", "no turn number"), (5, 1, "user", "tie"), (5, 1, "user", "tie"), (5, 1, "bot", "tie"), (None, 1, "user", "no conversation")]
    rnd.shuffle(turns)
    return turns


@pytest.mark.parametrize("seed, run, chunk", [(1, 1024, 4096), (2, 2, 3)])
def test_trie(frame, rows, monkeypatch, seed, run, chunk):
    monkeypatch.setattr(prefix_trie, "RUN", run)
    monkeypatch.setattr(prefix_trie, "CHUNK", chunk)
    turns = talk(seed)
    got = prefix_trie.trie(frame([(*t, 1, "x", 2) for t in turns], TURNS).repartition(3))
    assert rows(got) == brute_trie(turns)


def test_trie_few_rows(frame, rows):
    assert prefix_trie.trie(frame([], TURNS)).count() == 0
    # Its own turn is replaced, and there is no conversation 0: nothing is left but the root.
    c = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6)
    got = rows(prefix_trie.trie(frame([(c, 1, "user", "hi", 1, "x", 2)], TURNS)))
    assert got == [(c, 0, None, 1, 0, 1, 0, sha(str(c)))]


@pytest.mark.parametrize("name", ["op11_decontamination", "op12_merkle_manifest", "op13_prefix_trie"])
def test_sql_twin(spark, rows, sf_dir, name):
    connection = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = QUERIES[name](spark, sf_dir)
    result = connection.execute(ORACLES[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(got.columns)
    assert rows(got.select(*columns)) == sorted(result.fetchall(), key=repr)
