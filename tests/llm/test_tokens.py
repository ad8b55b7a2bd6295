import random
import subprocess
import sys
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from helpers import frame
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import checksums, pretoken, token_counts, token_records

PATH = public_tokenizers.path("byte_bpe_50k.json")
D = "/root/testdata/sf0.001"
TEXTS = [None, "", " ", "a  b", "don't we'll 'sx ''s I'd x'RE", "<|endoftext|>", "a<|endoftext|> b<|endoftext|>", "<|endof", "text|>", "aaaaaaaaaaaaaaa", "\r\n\r\n x", "中文 é²½🙂", "  x　"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_counts_and_ids_equal_the_library(library):
    rng = random.Random(4)
    alphabet = "ab  \n\t'stremvld09²½ é!?.,中  x🙂́"
    texts = TEXTS + ["".join(rng.choice(alphabet) if rng.random() > 0.03 else "<|endoftext|>" for _ in range(rng.randrange(40))) for _ in range(1500)]
    want = [ids(library, t) for t in texts]
    n_bytes, n = token_counts.counts(pa.array(texts), PATH)
    assert n.tolist() == [len(x) for x in want] and n_bytes.tolist() == [len((t or "").encode()) for t in texts]
    flat, count = token_records.encoder(PATH).encode(pa.array(texts))
    at = np.concatenate([[0], np.cumsum(count)])
    assert [flat[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.characters(blacklist_categories=["Cs", "Cn"]), max_size=40), min_size=1, max_size=8))
def test_any_text(texts):
    library = Tokenizer.from_file(PATH) if not hasattr(test_any_text, "lib") else test_any_text.lib
    test_any_text.lib = library
    _, n = token_counts.counts(pa.array(texts), PATH)
    assert n.tolist() == [len(ids(library, t)) for t in texts]


def test_long_text_in_blocks(library, monkeypatch):
    text = "the quick brown fox's  jump, " * 300
    want = len(ids(library, text))
    for size in (64, 1000):
        monkeypatch.setattr(pretoken.blocks, "__defaults__", (size, None))
        assert token_counts.counts(pa.array([text, "x", text]), PATH)[1].tolist() == [want, 1, want]


SCRIPTS = {
    "cyrillic": "Все люди рождаются свободными и равными в своём достоинстве, и правах; они'с наделены 12разумом. ",
    "chinese": "人人生而自由，在尊严和权利上一律平等。他们赋有理性和良心，并应以兄弟关系的精神相对待。",
    "arabic": "يولد جميع الناس أحراراً متساوين في الكرامة والحقوق، وقد وهبوا عقلاً وضميراً. ",
    "mixed": "it's 'll<|endoftext|>'s x'' '1 ''a!'s\u3000\u3000b \r\n🙂🙂'🙂é9 ",
}


@pytest.mark.parametrize("script", sorted(SCRIPTS))
def test_long_texts_of_any_script_are_cut(library, monkeypatch, script):
    text = SCRIPTS[script] * 60
    want = ids(library, text)
    specials = pretoken.special_tokens(PATH)
    raw = np.frombuffer(text.encode(), np.uint8)
    for size in (1, 7, 64, 1000):
        pieces = [p.tobytes() for _, _, p, _ in pretoken.blocks(raw, np.array([0, len(raw)]), size, specials)]
        assert b"".join(pieces) == text.encode() and max(map(len, pieces)) <= size + 90
        assert [i for p in pieces for i in ids(library, p.decode())] == want
        monkeypatch.setattr(pretoken.blocks, "__defaults__", (size, None))
        assert token_counts.counts(pa.array([text]), PATH)[1].tolist() == [len(want)]


@pytest.mark.parametrize("script", ["cyrillic", "chinese"])
def test_memory_of_a_long_text(script):
    code = f"""
import resource, pyarrow as pa
from tessera.llm import token_counts
text = {SCRIPTS[script]!r}
small, long = pa.array([text * 20000]), pa.array([text * (24_000_000 // len(text.encode()))])
token_counts.counts(small, {PATH!r})
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
token_counts.counts(long, {PATH!r})
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    used = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True)
    assert int(used.stdout) < 250


def test_shuffled_reader(spark, library):
    rows = [(i, f"text of {i} " * (i % 7)) for i in range(200)] + [(None, None)] * 3 + [(5, "again")]
    index = token_records.write(frame(spark, rows), PATH, 2).cache()
    got = token_records.read_shuffled(index, 7).orderBy("place").collect()
    assert sorted(((r["doc_id"], r["ids"]) for r in got), key=repr) == sorted(((i, [*ids(library, t), 2]) for i, t in rows), key=repr)
    order = [r["doc_id"] for r in got]
    assert order != sorted(order, key=lambda d: (d is not None, d)) and order == [r["doc_id"] for r in token_records.read_shuffled(index, 7, 3).orderBy("place").collect()]
    assert order != [r["doc_id"] for r in token_records.read_shuffled(index, 8).orderBy("place").collect()]
    assert token_records.read_shuffled(index.where("false"), 1).count() == 0


def test_repeated_rows_are_parted(spark):
    df = spark.range(0, 4000, 1, 8).selectExpr("cast(null as long) AS doc_id", "cast(null as string) AS text")
    index = token_records.write(df, PATH, 2, partitions=4)
    parts = [r["count"] for r in index.groupBy("part").count().collect()]
    assert sum(parts) == 4000 and max(parts) <= 2000


def test_query_counts(spark, library):
    from tessera.llm import queries

    got = {r["doc_id"]: r for r in queries.op9_token_counts(spark, D).collect()}
    for r in queries.table(spark, D, "documents").collect():
        n = len(ids(library, r["text"]))
        assert (got[r["doc_id"]]["n_bytes"], got[r["doc_id"]]["n_tokens"], got[r["doc_id"]]["over_limit"]) == (len((r["text"] or "").encode()), n, n > 512)


def test_crc32c():
    raw = np.frombuffer(b"123456789" + bytes(32), np.uint8)
    assert checksums.crc32c(raw, np.array([0, 9, 0]), np.array([9, 32, 0])).tolist() == [0xE3069283, 0x8A9136AA, 0]

    def slow(b):
        c = 0xFFFFFFFF
        for x in b:
            c ^= x
            for _ in range(8):
                c = c >> 1 ^ (0x82F63B78 if c & 1 else 0)
        return c ^ 0xFFFFFFFF

    rng = np.random.default_rng(0)
    raw = rng.integers(0, 256, 3000).astype(np.uint8)
    at, n = rng.integers(0, 2000, 40), rng.integers(0, 900, 40)
    assert checksums.crc32c(raw, at, n).tolist() == [slow(raw[a : a + k].tobytes()) for a, k in zip(at, n, strict=True)]


def test_frames_round_trip():
    flat, counts = np.array([1, 2, 70000, 5], np.int32), np.array([2, 0, 2])
    data, lengths = token_records.frames(flat, counts, [7, None, -1])
    assert sum(lengths) == len(data)
    assert [(d, x.tolist()) for _, d, x in token_records.parse(data)] == [(7, [1, 2]), (None, []), (-1, [70000, 5])]
    for k in (0, 9, 20, len(data) - 1):
        broken = bytearray(data)
        broken[k] ^= 1
        with pytest.raises(ValueError):
            token_records.parse(bytes(broken))


def restated_records(library, rows):
    out, start = [], 0
    for d, t in rows:
        x = [*ids(library, t), 2]
        out.append((d, start, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        start += len(x)
    return out


def records(spark, df):
    index = token_records.write(df, PATH, 2)
    out = token_records.with_starts(token_records.read(index))
    return index, sorted(((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in out.collect()), key=lambda r: r[1])


def test_query_records(spark, library):
    from tessera.llm import queries

    rows = sorted(tuple(r) for r in queries.table(spark, D, "documents").select("doc_id", "text").collect())
    got = sorted(tuple(r) for r in queries.op5_token_records(spark, D).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert got == restated_records(library, rows)


def test_records_of_odd_rows(spark, library):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, "twice"), (3, "twice"), (None, "first")]
    df = spark.createDataFrame([(*r, 1, "f") for r in rows], "doc_id long, text string, offset int, file string").repartition(3)
    index, got = records(spark, df)
    assert got[0][0] is None and [g[0] for g in got[1:]] == sorted(g[0] for g in got[1:])
    assert sorted(g[2:] for g in got) == sorted(r[2:] for r in restated_records(library, rows))
    assert got[-1][1] + got[-1][2] == sum(g[2] for g in got)
    assert index.count() == len(rows) and token_records.read_shuffled(index, 1).count() == len(rows)


def test_no_rows(spark):
    assert records(spark, frame(spark, []))[1] == []
    assert token_counts.count_tokens(frame(spark, []), PATH).count() == 0


def test_words_are_not_split_again(library):
    """Encoding words that are all different takes less time than the library needs to split and encode the text."""
    rng = random.Random(7)
    text = pa.array(["".join(" " + "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(3000)) for _ in range(10)])
    took = {"own": [], "library": []}
    for _ in range(3):
        own = token_records.Encoder(PATH)
        began = time.process_time()
        found = own.encode(text)[0].tolist()
        took["own"].append(time.process_time() - began)
        began = time.process_time()
        want = [i for t in text.to_pylist() for i in ids(library, t)]
        took["library"].append(time.process_time() - began)
        assert found == want
    assert min(took["own"]) < min(took["library"])


def test_files_are_read_once(spark):
    index = token_records.write(frame(spark, [(i, "a b c") for i in range(20)]), PATH, 2)
    out = token_records.with_starts(token_records.read(index))
    assert sorted(r["start"] for r in out.collect()) == [4 * i for i in range(20)]
    assert "MapInArrow" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_frequent_pieces_are_encoded_once(library, monkeypatch):
    """When the encoder's memory is full, what most blocks have stays, and ids are the library's all along."""
    monkeypatch.setattr(token_records, "MEMO_PIECES", 100)
    lib, asked = token_records.Encoder(PATH), []

    class Counted:
        def __init__(self, model):
            self.tokenize = lambda piece: asked.append(piece) or model.tokenize(piece)

    lib.model = Counted(lib.model)
    common = " the quick brown fox's jump<|endoftext|>"
    for k in range(60):
        text = common + "".join(f" {chr(97 + k % 26)}z{chr(97 + k // 26)}q{chr(97 + i)}w" for i in range(7)) + common
        flat, count = lib.encode(pa.array([text, None]))
        assert flat.tolist() == ids(library, text) and count.tolist() == [len(flat), 0]
    assert len(lib.memo) < 150 and not any("endoftext" in p for p in asked)
    assert all(asked.count(p) == 1 for p in ("Ġthe", "Ġquick", "Ġbrown", "Ġfox", "'s", "Ġjump"))
