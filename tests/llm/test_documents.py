"""Pieces, manifests and periodic runs against the library, plain Python and brute force."""

import hashlib
import os
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from founderflow.llm import merkle, periodic, pieces

public_tokenizers = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
sha = lambda s: hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()


def documents(n, seed=1):
    rng = random.Random(seed)
    words = ["the", "loop", "Again", "é", "中文", "x" * 30, "<s>", "▁", "1234"]
    out = []
    for i in range(n):
        body = [rng.choice(words) for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.4:
            body = body[:5] + body[5:9] * rng.randint(1, 7) + body[9:]
        text = rng.choice([" ", "  ", "\n", "\t"]).join(body)
        out.append((i, rng.choice([text, text, text, "", None]), rng.choice(["en", None]), rng.choice(["a", "b", "é", None]), rng.choice([len(text), None])))
    return [*out, (None, "Null id", "en", "a", 7), (3, "twice", None, "b", 5), (3, "twice", None, "b", 5)]


@pytest.fixture(scope="module")
def model():
    return public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def both(model):
    import sentencepiece

    return pieces.vocabulary(model), sentencepiece.SentencePieceProcessor(model_file=model)


def agree(both, texts):
    own, lib = both
    ids, at = own.encode(pa.array(texts, pa.string()))
    want = lib.encode(texts, add_bos=True, add_eos=True)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == want
    assert own.decode(ids, at) == lib.decode(want)


def test_pieces_as_the_library_has_them(both):
    agree(both, ["", " ", "a", " a", "a  b   c ", "▁", "▁x ▁", "\n\n", "é中文字符", "😀", "<s></s><unk><0x0A>", "\x00a", "aaaa aaaaa", "x" * 500, " " * 300 + "b", "ab" * 700])
    rng = random.Random(5)
    parts = ["a", "b", "th", "e", " ", "  ", "▁", "in", "ing", "1", "\n", "é", "中", "😀", "er", "tion", "ж", "=", "​"]
    for _ in range(60):
        agree(both, ["".join(rng.choice(parts) for _ in range(rng.randint(0, 90))) for _ in range(40)])


def test_long_words_are_finished_by_a_heap(both):
    rng = random.Random(6)
    agree(both, ["".join(rng.choice(a) for _ in range(3000)) for a in ("ab", "etain", "etainosrlhd", " ", "01", "abcdefghijklmnopqrstuvwxyz0123456789+/ABCDEFGHIJKLMNOPQRSTUVWXYZ")])


def test_any_ids_decode(both):
    rng = random.Random(7)
    own, lib = both
    for _ in range(300):
        ids = [rng.choice([0, 1, 2, 3, 200, 250, 259, 260, 29871, rng.randrange(32000)]) for _ in range(rng.randint(0, 8))]
        assert own.decode(np.array(ids, np.int64), np.array([0, len(ids)]))[0] == lib.decode(ids)
    with pytest.raises(ValueError):
        own.decode(np.array([32000]), np.array([0, 1]))


def test_pieces_query(spark, frames, both):
    rows = documents(60)
    got = sorted(map(tuple, pieces.op11_pieces(spark, frames(documents=(rows, DOCS))).collect()), key=repr)
    want = []
    for i, t, *_ in rows:
        ids = both[1].encode(t or "", add_bos=True, add_eos=True)
        want.append((i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(both[1].decode(ids))))
    assert got == sorted(want, key=repr)


def test_pieces_stored_and_read_back(spark, model):
    docs = spark.createDataFrame([(1, "a b", "own"), (2, None, None)], "doc_id long, text string, ids string")
    out = pieces.decoded(pieces.encoded(docs, model), model, "ids_")
    assert out.columns == ["doc_id", "text", "ids", "ids_", "decoded"]
    assert {r.doc_id: (r.decoded, r.ids, len(r.ids_)) for r in out.collect()} == {1: ("a b", "own", 16), 2: ("", None, 8)}
    assert pieces.encoded(docs.limit(0), model).count() == 0


def plain_manifest(rows):
    """(doc_id, leaf, subroot, root, proof, folded root, verified) for rows of the table, by plain lists."""

    def leaf(text, row):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], text)))

    def up(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][k:k + 16])) for k in range(0, len(levels[-1]), 16)])
        return levels

    def path(levels, i):
        out = []
        for nodes in levels[:-1]:
            low = i // 16 * 16
            out.append(("".join(nodes[low:i]), "".join(nodes[i + 1:low + 16])))
            i //= 16
        return out

    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append((leaf(r[1], r), r))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        groups[s].sort(key=lambda x: (x[1][0] is not None, x[1][0] or 0, x[0]))
        trees[s] = up([h for h, _ in groups[s]])
    top = up([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, (h, r) in enumerate(groups[s]):
            steps = path(trees[s], i) + path(top, k)
            changed = zlib.crc32(b"" if r[0] is None else str(r[0]).encode()) % 5 == 0
            now = leaf("".join(c.lower() if "A" <= c <= "Z" else c for c in r[1]), r) if changed and r[1] is not None else h
            for a, b in steps:
                now = sha(a + now + b)
            out.append((r[0], h, trees[s][-1][0], top[-1][0], sha("".join(a + b for a, b in steps)), now, now == top[-1][0]))
    return sorted(out, key=repr)


def manifest_of(spark, path):
    return sorted(map(tuple, merkle.op12_manifest(spark, path).collect()), key=repr)


def test_manifest(spark, frames):
    rows = documents(150)
    got = manifest_of(spark, frames(documents=(rows, DOCS)))
    assert got == plain_manifest(rows) and {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("n", [1, 16, 17])
def test_manifest_of_one_source(spark, frames, n):
    rows = [(i, f"Text {i}", "en", "only", i) for i in range(n)]
    assert manifest_of(spark, frames(documents=(rows, DOCS))) == plain_manifest(rows)


def test_manifest_of_several_stages(spark, frames):
    """Blocks of one level: sources of three stages, and a tree of sources of two."""
    rows = documents(700, 2) + [(1000 + i, "t", None, f"site {i}", 1) for i in range(20)]
    path = frames(documents=(rows, DOCS))
    want = {r[:5] for r in plain_manifest(rows)}
    got = merkle.manifest(spark.read.parquet(f"{path}/documents.parquet"), depth=1).collect()
    assert {(r.doc_id, r.leaf, r.subroot, r.root, sha(r.proof)) for r in got} == want
    assert len(got) == len(rows) and all(r.folded_root == r.root for r in got)


def test_paths_of_several_blocks():
    rng = random.Random(3)
    for n in (1, 2, 16, 17, 255, 257, 4096):
        nodes = [sha(str(rng.random())) for _ in range(n)]
        levels = merkle.levels_of(bytes.fromhex("".join(nodes)), merkle.depth_of(n))
        root = levels[-1].tobytes()
        assert len(root) == 64
        assert all(merkle.fold(h.encode(), p) == root for h, p in zip(nodes, merkle.siblings(levels)))


def test_manifest_of_nothing(spark, frames):
    assert manifest_of(spark, frames(documents=([], DOCS))) == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_manifest_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.sql(merkle.OP12_SQL)
    names = want.columns
    assert sorted(map(tuple, merkle.op12_manifest(spark, SF).select(*names).collect())) == sorted(want.fetchall())


def brute_runs(w, exponent=4, least=6):
    best = {}
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i + q - start >= max(least, exponent * q):
                best.setdefault((start, i + q - 1), q)
    return sorted((s, e - s + 1, q) for (s, e), q in best.items())


def test_runs_of_words():
    rng = random.Random(1)
    for _ in range(3000):
        n, letters = rng.randint(0, 70), rng.choice([1, 2, 3, 5])
        w = [rng.randrange(letters) for _ in range(n)]
        if n > 8 and rng.random() < 0.6:
            s, p = rng.randrange(n), rng.randint(1, 6)
            w = w[:s] + [w[min(n - 1, s + (i - s) % p)] for i in range(s, n)]
        assert periodic.runs_of(w) == brute_runs(w)
        assert periodic.runs_of(w, 2, 2) == brute_runs(w, 2, 2)
        assert periodic.runs_in(np.array(w, np.uint64), np.array([0, n // 2, n])) == [brute_runs(w[:n // 2]), brute_runs(w[n // 2:])]


def test_long_loops_stay_cheap():
    assert periodic.runs_of([0] * 50_000) == [(0, 50_000, 1)]
    assert periodic.runs_of([i % 700 for i in range(50_000)]) == [(0, 50_000, 700)]


def plain_periodic(i, text):
    words = (text or "").encode().split()
    h, n = zlib.crc32(b"" if i is None else str(i).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
    runs = brute_runs(words)
    gone = {k for s, m, q in runs for k in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    four = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (i, len(runs), *four, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(b" ".join(w for k, w in enumerate(words) if k not in gone)))


def test_runs_query(spark, frames):
    rows = documents(400, 4)
    got = sorted(map(tuple, periodic.op13_periodic_runs(spark, frames(documents=(rows, DOCS))).collect()), key=repr)
    assert got == sorted((plain_periodic(r[0], r[1]) for r in rows), key=repr) and sum(r[1] > 0 for r in got) > 20


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_runs_query_on_given_tables(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(map(tuple, periodic.op13_periodic_runs(spark, SF).collect()), key=repr)
    assert got == sorted((plain_periodic(*r) for r in rows), key=repr)


def test_runs_keep_other_columns(spark):
    docs = spark.createDataFrame([("x", "a b a b a b a b c"), ("y", None)], "runs string, text string")
    got = {r.runs: r for r in periodic.with_runs(docs).collect()}
    assert [tuple(r) for r in got["x"].runs_] == [(0, 8, 2)] and got["x"].collapsed == "a b c"
    assert got["y"].runs_ == [] and got["y"].collapsed == ""
    assert periodic.with_runs(docs.limit(0)).count() == 0


def test_workers_give_memory_back():
    """After a lean map of many small pieces this process is about as large as before, though a plain one keeps them."""
    import subprocess
    import sys

    code = """
import numpy as np, pyarrow as pa
from founderflow.llm import common
size = lambda: int(open("/proc/self/statm").read().split()[1]) * 4096 >> 20
def run(found):
    held = []
    for batch in found:
        held += [np.full(1000, i, np.int64) for i in range(25_000)]
    keep.append(np.full(1000, 1, np.int64))  # lies behind what is freed
    yield batch
keep, before = [], size()
list(common.lean(run)(iter([pa.RecordBatch.from_arrays([pa.array([1])], ["x"])])))
print(size() - before)
"""
    assert int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout) < 60
