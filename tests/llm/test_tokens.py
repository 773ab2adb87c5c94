"""BPE transducer, token counts and packing against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from vecprobe.llm.bpe import Encoder
from vecprobe.llm.packing import pack
from vecprobe.llm.textbuf import slices
from vecprobe.llm.token_counts import section_tokens
from vecprobe.llm.transducer import Lexicon, bpe_digests, bpe_roundtrip

from .texts import awkward

BYTE, WORD = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i, t, 1, "x") for i, t in enumerate(awkward())] + [(0, "tie text", 2, None), (None, "no id", 3, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, piece int, n_tokens string").repartition(3)


def _empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, ids string")


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_encoder_equals_the_library(path):
    texts = awkward(4000, 9)
    lib, enc = Tokenizer.from_file(path), Encoder(path)
    for s in slices(pa.array(texts), 20_000):
        ids, at = enc.encode(s)
        for i, e in enumerate(lib.encode_batch([t or "" for t in texts[s.start:s.start + len(s)]], add_special_tokens=False)):
            assert ids[at[i]:at[i + 1]].tolist() == e.ids


def test_lexicon_numbers_words_in_byte_order_and_rejects_others():
    rnd = random.Random(2)
    words = sorted({bytes(rnd.choices(b"abcd", k=rnd.randint(1, 8))) for _ in range(2000)})
    asked = words + [bytes(rnd.choices(b"abcde", k=rnd.randint(1, 9))) for _ in range(2000)]
    off = np.r_[0, np.cumsum([len(w) for w in asked])]
    lex = Lexicon.build(words, BYTE)
    got = lex.find(np.frombuffer(b"".join(asked), np.uint8), off[:-1], off[1:])
    number = {w: i for i, w in enumerate(words)}
    assert got.tolist() == [number.get(w, -1) for w in asked]
    assert len(lex.final) < sum(map(len, words)) / 4  # suffixes are shared
    assert Lexicon.build([], BYTE).find(np.frombuffer(b"ab", np.uint8), np.array([0]), np.array([2])).tolist() == [-1]


def test_roundtrip_and_digests(spark, table):
    lib = Tokenizer.from_file(BYTE)
    for words in (1 << 17, 5):
        exp = []
        for x in table.collect():
            ids = lib.encode(x.text or "", add_special_tokens=False).ids
            exp.append((x.doc_id, ids, lib.decode(ids, skip_special_tokens=False)))
        assert sorted(map(tuple, bpe_roundtrip(table, BYTE, words).collect()), key=repr) == sorted(exp, key=repr)
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe_digests(table, BYTE).collect()}
    exp = set()
    for x in table.collect():
        ids = lib.encode(x.text or "", add_special_tokens=False).ids
        exp.add((x.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                 hashlib.sha256((x.text or "").encode()).hexdigest()))
    assert got == exp
    assert bpe_digests(_empty(spark), BYTE).count() == 0


def test_section_counts_equal_brute_force(spark, table):
    lib = Tokenizer.from_file(BYTE)
    exp = []
    for x in table.collect():
        t = x.text or ""
        ends = [i + 1 for i, c in enumerate(t) if c == "\n" and i + 1 < len(t)] + [len(t)]
        spans = list(zip([0, *ends[:-1]], ends, strict=True))
        n, crossing = [0] * len(spans), [0] * len(spans)
        for a, b in lib.encode(t, add_special_tokens=False).offsets:
            over = [min(b, e) - max(a, s) for s, e in spans]
            k = over.index(max(over))
            n[k] += 1
            crossing[k] += sum(o > 0 for o in over) > 1
        exp += [(x.doc_id, k, s, e, n[k], crossing[k]) for k, (s, e) in enumerate(spans)]
    got = [tuple(r) for r in section_tokens(table, BYTE).collect()]
    assert sorted(got, key=repr) == sorted(exp, key=repr)
    assert section_tokens(_empty(spark), BYTE).count() == 0


def test_packing_is_whole_gapless_and_tight(spark, table):
    rnd = random.Random(4)
    more = spark.createDataFrame([(1000 + i, "w " * rnd.randrange(1, 130), 0, None) for i in range(600)], table.schema)
    docs = table.unionByName(more)
    lib = Tokenizer.from_file(WORD)
    rows = pack(docs, WORD, 128, shard=100).collect()
    exp = []
    for x in docs.collect():
        ids = lib.encode(x.text or "", add_special_tokens=False).ids + [0]
        for k, a in enumerate(range(0, len(ids), 128)):
            part = np.array(ids[a:a + 128], "<u4")
            exp.append((x.doc_id, k, a, len(part), zlib.crc32(part.tobytes())))
    key = lambda r: repr(tuple(r)[:5])
    assert sorted(map(key, rows)) == sorted(map(repr, exp))
    seq = {}
    for r in rows:
        seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 128
    least = -(-sum(r.length for r in rows) // 128)
    assert len(seq) <= least * 1.01 + 2
    assert pack(_empty(spark), WORD, 128).count() == 0


def _thue_morse(n: int) -> str:
    return "".join("ab"[bin(i).count("1") & 1] for i in range(n))


def test_words_that_polynomial_hashes_confuse_stay_apart(spark):
    import hashlib

    import numpy as np
    from tokenizers import Tokenizer

    from vecprobe.llm.fingerprints import fingerprint_versions
    from vecprobe.llm.jaccard_join import jaccard_groups
    from vecprobe.llm.packing import pack
    from vecprobe.llm.parameters import BYTE_BPE, WORD_BPE
    from vecprobe.llm.token_counts import section_tokens
    from vecprobe.llm.transducer import bpe_digests
    texts = []
    for n in (64, 512, 1024, 4096):
        one = _thue_morse(n)
        texts += [one, one.translate(str.maketrans("ab", "ba"))]
    texts += [f"{t} x y z w" for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)

    def sha(path):
        t = Tokenizer.from_file(path)
        return {i: hashlib.sha256(np.array(e.ids, "<u4").tobytes()).hexdigest() for i, e in enumerate(t.encode_batch(texts, add_special_tokens=False))}

    assert {r.doc_id: r.ids_sha256 for r in bpe_digests(df, BYTE_BPE).collect()} == sha(BYTE_BPE)
    byte, word = ([len(e.ids) for e in Tokenizer.from_file(p).encode_batch(texts, add_special_tokens=False)] for p in (BYTE_BPE, WORD_BPE))
    assert {r.doc_id: r.n_tokens for r in section_tokens(df, BYTE_BPE).collect()} == dict(enumerate(byte))
    pieces = pack(df, WORD_BPE, 100_000).collect()
    assert {r.doc_id: r.length - 1 for r in pieces} == dict(enumerate(word)) and len({r.ids_crc32 for r in pieces}) == len(texts)
    assert all(r.component_id == r.doc_id for r in jaccard_groups(df).collect())
    assert len({r.fingerprint for r in fingerprint_versions(df).collect()}) == len(texts)
