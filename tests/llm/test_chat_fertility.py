from __future__ import annotations

import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from edge_tables import edge, no_docs, table  # noqa: F401
from spendlens.llm import chat as C
from spendlens.llm import fertility as Q

TEXT = st.lists(st.sampled_from([*C.CONTROL, "\\", "<", "|", ">", "a", "\n", "[", "]", "<|turn|>", "<|end|>", "<|image:1|>", "é"]),
                max_size=9).map("".join)


@settings(max_examples=500, deadline=None)
@given(TEXT, st.one_of(st.just("assistant"), st.just("user"), TEXT))
def test_round_trip(text, role):
    f = C.Visitor().turn(role, [{"kind": "text", "text": text}])
    got, parts, learnt = C.read_turn(f.text, f.loss)
    assert got == role and "".join(p["text"] for p in parts) == text
    assert learnt == (text if role == "assistant" else "")
    body = f.text[:-len(C.END)].split("\n", 1)[1]
    assert not any(c in body for c in C.CONTROL)


def test_typed_parts(spark):
    parts = [("text", "see <|image:9|>", None, None, None, None, None), ("image", None, "s3/a.png", 28, 15, None, None),
             ("image", None, "b.png", None, None, None, None), ("audio", None, "c.wav", None, None, 2.0, None),
             ("document", None, "d.pdf", None, None, None, 3), ("video", None, "e.mp4", None, None, None, None), None]
    turns = spark.createDataFrame([(1, 0, "assistant", parts), (1, 1, "user", None), (2, 0, None, [])],
                                  f"conv_id long, turn long, role string, parts array<{C.PART}>")
    rows = {(r.conv_id, r.turn): r for r in C.format_turns(turns).collect()}
    r = rows[1, 0]
    assert r.formatted == "<|turn|>assistant|mask\nsee <\\|image:9|\\><|image:1|><|image:2|><|audio:1|><|document:1|><|other:1|><|end|>"
    assert [(a.kind, a.number, a.ref, a.tokens) for a in r.attachments] == [
        ("image", 1, "s3/a.png", 4), ("image", 2, "b.png", 1), ("audio", 1, "c.wav", 50), ("document", 1, "d.pdf", 1536), ("other", 1, "e.mp4", 1)]
    assert r.expanded_tokens == 1592
    _, back, learnt = C.read_turn(r.formatted, [(s.start, s.end) for s in r.loss])
    assert [p["kind"] for p in back] == ["text", "image", "image", "audio", "document", "other"] and learnt == "see <|image:9|>"
    whole = {r.conv_id: r for r in C.assemble(C.format_turns(turns)).collect()}
    assert whole[1].formatted == r.formatted + "<|turn|>user\n<|end|>"


def test_digests(spark):
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant", "system"]), rng.choice(["", None, "</s>", "x\\y", "hello there"]))
            for c in (1, 2, None) for t in (0, 1, 1, 2)] + [(5, 0, None, None), (6, None, "user", "no number")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r.conv_id: r for r in C.digests(C.format_turns(C.as_parts(turns))).collect()}
    for conv in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == conv]
        o = out[conv]
        assert o.n_turns == len(own) and o.loss_chars == sum(len(r[3] or "") for r in own if r[2] == "assistant")
    pair = C.digests(C.format_turns(C.as_parts(C.probe(spark)))).first()
    text = "</s>[INST] ok [/INST]"
    assert pair.turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert pair.loss_sha256 == hashlib.sha256(text.encode()).hexdigest() and pair.loss_chars == len(text)
    assert C.digests(C.format_turns(C.as_parts(turns.limit(0)))).collect() == []


def slow_counts(text):
    """Base measures of operator 4 by the definitions."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    at: dict = {}
    for i in range(len(words) - 7):
        at.setdefault(tuple(words[i:i + 8]), []).append(i)
    covered = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


@pytest.fixture(scope="module")
def rules(table):
    return {r.doc_id: r for r in Q.fertility_rules(table("documents")).collect()}


def test_base_counts(rules, table):
    for r in table("documents").collect():
        o = rules[r.doc_id]
        want = slow_counts(r.text)
        assert (o.n_words, o.word_chars, o.n_symbols, o.n_dup_lines, o.n_repeat_words) == want
        assert o.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and not (o.base_failed and o.kept)


def test_fertility_against_the_library(rules, table):
    import math
    from collections import Counter
    sp, is_byte = Q._pieces(Q.VOCABULARIES)
    for r in table("documents").limit(25).collect():
        ids = [i for w in re.findall(r"[^\x20\x09-\x0D]+", r.text) for i in sp.encode(w)]
        o, n = rules[r.doc_id], len(ids)
        assert abs(o.chars_per_token - o.word_chars / n) < 1e-12 and abs(o.byte_share - sum(is_byte[ids]) / n) < 1e-12
        h = -sum(c / n * math.log2(c / n) for c in Counter(ids).values())
        assert abs(o.token_entropy - h / math.log2(min(max(n, 2), len(is_byte)))) < 1e-9


def test_bands(spark, edge, no_docs):
    rows = [(1, "The weather in town was fine this morning, so we walked along the river and talked about the books that "
                "our teacher had given us before the long summer holidays began."),
            (2, " ".join("zqxj%d%s" % (i * 7919, "kvw"[i % 3] * 3) for i in range(60))),
            (3, " ".join("𐎀𐎁𐎂" for _ in range(5)) + " ĂĽĹĚĐŁ" * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r for r in Q.fertility_rules(docs).collect()}
    assert out[1].kept and not out[2].kept and not out[3].kept and out[1].script == "latin"
    strict = Q.fertility_rules(docs, bands={"latin": Q.Band(50, 60, 0, 0)})
    assert not any(r.kept for r in strict.collect())
    assert Q.fertility_rules(edge).count() == 9 and Q.fertility_rules(no_docs).collect() == []
    assert {r.doc_id: (r.n_words, r.kept) for r in Q.fertility_rules(edge).collect()}[1] == (0, False)


def test_ties_of_a_turn_come_by_role_and_raw_text(spark):
    rows = [(1, 0, "assistant2", "x"), (1, 0, "assistant", "<|"), (1, 0, "assistant", "<a"), (1, 1, "user", "b\\"), (1, 1, "user", "bA"), (1, 1, None, "z")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    formatted = C.format_turns(C.as_parts(turns))
    want = sorted(rows, key=lambda r: (r[1], r[2] or "", r[3]))
    got = C.digests(formatted).collect()[0]
    assert got.turns_sha256 == hashlib.sha256("".join(f"{r[2] or ''}\n{r[3]}\n" for r in want).encode()).hexdigest()
    assert got.loss_sha256 == hashlib.sha256(b"<a<|").hexdigest()
    whole = C.assemble(formatted).collect()[0].formatted
    assert [m.start() for m in re.finditer("assistant2|z\\n|bA", whole)] == sorted(m.start() for m in re.finditer("assistant2|z\\n|bA", whole))
