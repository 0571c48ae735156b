"""Chat, BPE, packing and word-level operators, against the tokenizers library and plain Python."""

import hashlib
import zlib

import numpy as np
import pytest
from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st

from helixspark.llm import bpe, chat, packing, quality_rules
from helixspark.llm.queries import tokenizer
from helixspark.llm.words import words_of

ODD = ["", " ", "\n", "a", "a  b\n\n c ", "it's we'll 'tis", "é́ß ñ", "你好 мир १२३", "x" * 5000, "<|endoftext|>a <|endoftext|>", "  \x1c\x85", "🙂‍🙂", "1234567 ½ Ⅷ", "\t\ttab\r\n"]
SCHEMA = "doc_id long, text string, sequence_id string, shard int"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "clash", 7) for i, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return {n: Tokenizer.from_file(tokenizer(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json")}


@settings(max_examples=300, deadline=None)
@given(st.text())
def test_bpe_like_library(text):
    from tokenizers import Tokenizer

    t = test_bpe_like_library.t = getattr(test_bpe_like_library, "t", None) or Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    c = bpe.codec(tokenizer("byte_bpe_50k.json"))
    ids = t.encode(text, add_special_tokens=False).ids
    assert c.encode(text).tolist() == ids
    assert c.decode(ids) == t.decode(ids, skip_special_tokens=False)


def test_bpe_operator(spark, library):
    t = library["byte_bpe_50k.json"]
    path = tokenizer("byte_bpe_50k.json")
    got = bpe.encode_decode(docs(spark, [*ODD, None, "a"]), path, outputs=("ids", "decoded", "n_tokens", "ids_sha256", "decoded_sha256")).toPandas().set_index("doc_id")
    for i, text in enumerate([*ODD, "", "a"]):
        ids = t.encode(text, add_special_tokens=False).ids
        assert list(got.ids[i]) == ids and got.decoded[i] == text and got.n_tokens[i] == len(ids)
        assert got.ids_sha256[i] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert bpe.encode_decode(docs(spark, []), path).count() == 0
    back = bpe.decode_documents(bpe.encode_decode(docs(spark, ODD), path), path)
    assert {r.doc_id: r.decoded for r in back.collect()} == dict(enumerate(ODD))


def test_bpe_query(spark, library):
    """The registered query over the whole table, against the library."""
    import pandas as pd

    from helixspark.llm.queries import op2_bpe

    t = library["byte_bpe_50k.json"]
    d = pd.read_parquet(f"{SF}/documents.parquet")
    got = op2_bpe(spark, SF).toPandas().set_index("doc_id")
    assert sorted(got.index) == sorted(d.doc_id)
    for i, text in zip(d.doc_id, d.text.fillna("")):
        ids = t.encode(text, add_special_tokens=False).ids
        own = got.loc[i]
        assert own.n_tokens == len(ids) and own.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert own.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<>|/[]INSTs\\ab\n_"))
def test_escape(text):
    e = chat.escape(text)
    assert chat.unescape(e) == text
    assert not any(x in e for x in ("<s>", "</s>", "[INST]", "[/INST]", "<|"))


def expected(turns):
    """Digests of turns (role, text)."""
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_chat(spark, monkeypatch):
    rows = [(1, i, "assistant" if i % 2 else "user", t, "x") for i, t in enumerate([*ODD, "</s>[INST] ok [/INST]", "<|turn|>user<|text|>"])]
    rows += [(2, 0, "assistant", None, "x"), (2, 0, None, "b", "x"), (2, 1, "assistant", "z", "x"), (2, 1, "assistant", "z", "x"), (None, 5, "assistant", "n", "x"), (None, None, "user", "m", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    path = tokenizer("byte_bpe_50k.json")
    got = {r.conv_id: tuple(r)[1:5] for r in chat.digests(chat.format_conversations(df, path)).collect()}
    assert got[1] == expected([(r[2], r[3]) for r in rows if r[0] == 1])
    assert got[2] == expected([("", "b"), ("assistant", ""), ("assistant", "z"), ("assistant", "z")])
    assert got[None] == expected([("user", "m"), ("assistant", "n")])
    assert chat.digests(chat.format_conversations(df.limit(0), path)).count() == 0


def test_chat_segments_are_the_whole(spark):
    """A conversation of many segments over several tasks has the tokens of the whole."""
    turns = [("assistant" if i % 2 else "user", f" text {i} é" * 300) for i in range(400)]
    df = spark.createDataFrame([(9, i, r, t) for i, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    path = tokenizer("byte_bpe_50k.json")
    parts = chat.format_conversations(df, path).orderBy("segment").collect()
    whole, spans = chat.render(turns)
    assert len(parts) > 4 and "".join(p.formatted for p in parts) == whole
    e = chat._tokenizer(path).encode(whole, add_special_tokens=False)
    assert [i for p in parts for i in p.ids] == e.ids
    assert [m for p in parts for m in p.loss_mask] == chat.token_mask(np.array(e.offsets), spans).tolist()
    assert tuple(chat.digests(chat.format_conversations(df, path)).first())[1:5] == expected(turns)


def test_chat_query(spark):
    import pandas as pd

    from helixspark.llm.queries import op1_chat

    got = op1_chat(spark, SF).toPandas().set_index("conv_id")
    t = pd.read_parquet(f"{SF}/conversations.parquet").sort_values(["conv_id", "turn"])
    for k, g in t.groupby("conv_id"):
        r = got.loc[k]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == expected(list(zip(g.role, g.text)))
    assert -7 in got.index and len(got) == t.conv_id.nunique() + 1


def check_packing(got, texts, t):
    seen = got.set_index(["doc_id", "piece"]).sort_index()
    n = 0
    for i, text in enumerate(texts):
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 2048):
            r, own = seen.loc[(i, k // 2048)], ids[k : k + 2048]
            n += 1
            assert (r.start, r.length, r.ids_crc32) == (k, len(own), zlib.crc32(np.array(own, dtype="<u4").tobytes()))
    assert n == len(got)
    g = got.sort_values(["sequence_id", "offset"])
    assert (g.groupby("sequence_id").length.cumsum() - g.length == g.offset).all() and g.groupby("sequence_id").length.sum().max() <= 2048


def best_fit_decreasing(lengths):
    import bisect

    free, n = [], 0
    for x in sorted(lengths, reverse=True):
        k = bisect.bisect_left(free, x)
        room = free.pop(k) if k < len(free) else 2048
        n += room == 2048
        bisect.insort(free, room - x)
    return n


def test_packing(spark, library):
    t = library["word_bpe_49k.json"]
    texts = [*ODD, None, "word " * 5000, "İstanbul ŉ ǅ", "<|startoftext|>x", "<|ENDOFTEXT|>"] + ["lorem ipsum dolor " * (37 * i % 400) for i in range(300)]
    cut = packing.pieces(docs(spark, texts), tokenizer("word_bpe_49k.json"), with_ids=True)
    for block in (4096, 64):
        packed = packing.pack(cut, block=block).toPandas()
        check_packing(packed, texts, t)
        assert packed.sequence_id.nunique() <= best_fit_decreasing(packed.length) + (block == 64)
    whole = packing.sequences(packing.pack(cut)).toPandas()
    assert sum(map(len, whole.ids)) == packed.length.sum() and max(map(len, whole.ids)) <= 2048
    assert packing.pack(packing.pieces(docs(spark, []), tokenizer("word_bpe_49k.json"))).count() == 0


def test_packing_query(spark, library):
    import pandas as pd

    from helixspark.llm.queries import op5_packing

    d = pd.read_parquet(f"{SF}/documents.parquet").set_index("doc_id").text
    got = op5_packing(spark, SF).toPandas()
    check_packing(got, [d[i] for i in range(len(d))], library["word_bpe_49k.json"])
    assert got.sequence_id.nunique() <= best_fit_decreasing(got.length)


def test_crossover_keeps_all():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 1500, 400)
    first = packing.first_population(lengths, None, 2048, rng, 4)
    child = packing.cross(first[0], first[-1], lengths, 2048, rng)
    for x in (*first, child):
        assert (x >= 0).all() and packing.rooms(x, lengths, 2048).min() >= 0 and len(np.unique(x)) == x.max() + 1
    best = packing.evolve(first, lengths, 2048, rng, 20, 4)[0]
    assert packing.fitness(best, lengths, 2048) <= min(packing.fitness(x, lengths, 2048) for x in first)


def rules_of(text):
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text or "")]
    places = {}
    for i in range(len(words) - 4):
        places.setdefault(tuple(words[i : i + 5]), []).append(i)
    hit = {j for v in places.values() if len(v) > 1 for i in v for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if words_of(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


def test_rules(spark):
    texts = [*ODD, None, "a b c d e " * 30, "x\ny\nx\nx\n \n", "# * $ % & | < >", "one two three four five six seven eight nine ten eleven", "THE CAT!! " * 3 + "q w e r t y u i o p"]
    df = docs(spark, texts * 2).withColumn("failed", quality_rules.F.lit("clash"))
    got = quality_rules.ledger(df).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "failed", "sequence_id").toPandas()
    assert len(got) == 2 * len(texts)
    for r in got.itertuples():
        want = rules_of(texts[r.doc_id % len(texts)])
        assert tuple(r)[2:7] == want
        assert bool(r.failed & quality_rules.BASE) == (want[0] < 10 or 100 * want[4] > 20 * want[0])
    kept = quality_rules.keep_good(docs(spark, texts)).toPandas()
    assert list(kept.columns) == ["doc_id", "text", "sequence_id", "shard"] and "one two three four five six seven eight nine ten eleven" in set(kept.text)
    a = {r.rule: r for r in quality_rules.ablations(quality_rules.ledger(docs(spark, texts)), "v1").collect()}
    fails = got[got.doc_id < len(texts)].failed
    bit = quality_rules.BITS["few_words"]
    assert a["few_words"].n_failed == (fails & bit != 0).sum() and a["few_words"].n_only == (fails == bit).sum() and a["few_words"].n_kept_without == fails.isin([0, bit]).sum()
    assert quality_rules.ledger(docs(spark, [])).count() == 0


def test_windows_of_one_hash(monkeypatch):
    """Windows whose hashes collide are told apart."""
    words = [*"a b c d e f a b c d e g h i j k".split(), *"a b c d e".split()]
    want = quality_rules.repeat_words(words, np.array([16, 5]))
    assert want.tolist() == [10, 0]

    class Rng:
        def integers(self, low, high, size, dtype):
            return np.zeros(size, dtype=np.uint64)

    monkeypatch.setattr(np.random, "default_rng", lambda seed: Rng())
    assert quality_rules.repeat_words(words, np.array([16, 5])).tolist() == [10, 0]


def test_rules_oracle(spark, duck):
    from conftest import rows

    from helixspark.llm.queries import ORACLE_SQL, QUERIES

    for name in ("op6_quality_rules", "op7_exact_dedup", "quality_ablations"):
        assert rows(QUERIES[name](spark, SF).toPandas()) == rows(duck.sql(ORACLE_SQL[name]).df())
