"""Spelling variants, fill-in-the-middle and chat formats, against plain loops."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from imprint.llm import chat, infill, spelling
from imprint.llm.queries import CONTROL_TEXT, QUERIES, read_conversations
from tests.llm import brute
from tests.llm.conftest import ODD

FOLDER = "/root/testdata/sf0.001"
NAMES = "key node score n_words level share word n side drops read edits form output conv chunk alone entry turns code text_2".split()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def clashing_with(frame):
    return frame.withColumns({n: F.lit(1) for n in NAMES if n not in frame.columns})


# spelling


def words_of(spark, words):
    return spark.createDataFrame(list(words.items()), "word string, n bigint").repartition(3)


def test_variants_of_the_small_table(spark, small):
    got = ordered(QUERIES["op11_spelling_variants"](spark, FOLDER).collect())
    assert got == ordered(brute.variants(brute.counted_words(small)))
    assert sum(r[1] is not None for r in got) > 20


def made_words(seed, letters, sizes, count):
    rng = random.Random(seed)
    words = {}
    while len(words) < count:
        w = "".join(rng.choice(letters) for _ in range(rng.choice(sizes)))
        for _ in range(4):
            words.setdefault(w, rng.choice([3, 3, 4, 6, 12, 24, 50]))
            k = rng.randrange(len(w))
            w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k + 1 :], w[:k] + rng.choice(letters) + w[k:]])
            if not 5 <= len(w) <= max(sizes) + 3:
                break
    return words


@pytest.mark.parametrize("seed, letters, sizes, longest, split", [
    (1, "ab", [5, 6, 7], 40, 50_000),
    (2, "aéÿb", [5, 8, 13], 40, 7),
    (3, "ab", [9, 11, 12, 14], 11, 50_000),
    (4, "abcdefgh×", [5, 6, 39, 40, 41, 42, 60], 40, 50_000),
])
def test_variants_of_made_words(spark, seed, letters, sizes, longest, split):
    words = made_words(seed, letters, sizes, 250)
    got = ordered(spelling.group_variants(words_of(spark, words), longest, split).collect())
    assert got == ordered(brute.variants(words))


def test_every_pair_comes_once(spark):
    words = made_words(5, "ab", [5, 6, 7, 8], 150)
    got = [(r.word, r.near) for r in spelling.neighbours(words_of(spark, words), longest=7).collect()]
    want = {(a, b) for a in words for b in words if brute.one_edit(a, b)}
    assert len(got) == len(set(got)) and set(got) == want


def test_forms_lead_on_to_a_root_and_ties_go_to_the_first(spark):
    words = {"aaaaa": 3, "aaaab": 6, "aaabb": 12, "aabbb": 24, "abbbb": 48, "zzzzz": 3, "zzzzb": 6, "zzzza": 6, "zzzzzz": 5}
    got = {r.word: r for r in spelling.group_variants(words_of(spark, words)).collect()}
    assert got["aaaaa"].form == "aaaab" and got["aaaaa"].root == "abbbb" and got["abbbb"].root == "abbbb"
    assert got["zzzzz"].form == "zzzza" and got["zzzzz"].form_n == 6 and got["zzzzb"].form is None
    assert ordered(got.values()) == ordered(brute.variants(words))


def test_words_of_odd_rows(spark, make, odd, empty):
    rows = [(1, "Éclair Éclair éclair ÉCLAIR"), (None, "nowhere nowhere nowhere"), (3, None), (4, "four"), (5, "x" * 5000 + " "), (5, "x" * 5000), (5, "x" * 5000), (6, "×÷×÷× " * 3)]
    got = {r.word: r.n for r in spelling.count_words(make(rows)).collect()}
    assert got == brute.counted_words(rows) and got["x" * 5000] == 3 and got["×÷×÷×"] == 3 and "Éclair" in got
    assert {r.word: r.n for r in spelling.count_words(clashing_with(odd)).collect()} == brute.counted_words(ODD)
    assert spelling.count_words(empty).count() == 0
    assert spelling.group_variants(spelling.count_words(empty)).count() == 0


def test_long_words_in_many_texts(spark, make):
    run = "acgt" * 500
    rows = [(d, run) for d in range(400)] + [(d, (run + " ") * 3) for d in range(400, 600)] + [(9000 + k, run[:-1]) for k in range(3)]
    words = brute.counted_words(rows)
    assert len(words) > 2
    got = ordered(spelling.group_variants(spelling.count_words(make(rows))).collect())
    assert got == ordered(brute.variants(words))


# fill in the middle


def check_infill(rows, frame, seed=1):
    got = infill.fill_in_middle(frame, seed).withColumn("restored", infill.restore(F.col("output"), F.col("form"))).collect()
    want = []
    for d, text, *_ in rows:
        n, form, p, m, _, output = brute.infilled(d, text, seed)
        want.append((d, n, form, None if p is None else len(p), None if m is None else len(m), output, text or ""))
    assert ordered(got) == ordered(want)
    return got


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_infill_of_the_small_table(make, small, seed):
    got = check_infill(small, make([r[:2] for r in small]), seed)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_infill_query(spark, small):
    want = []
    for d, text, *_ in small:
        n, form, p, m, _, output = brute.infilled(d, text)
        want.append((d, n, form, None if p is None else len(p), None if m is None else len(m), sha(output), sha(text or "")))
    assert ordered(QUERIES["op12_fill_in_middle"](spark, FOLDER).collect()) == ordered(want)


def test_infill_of_marks_and_odd_characters(make):
    texts = ["<P>", "a<S>b", "<M", "P><", "<<<P", "$1 \\ $2", "\r\n \u0085\x00", "\U0001f600\U0001f601é", "<", ">", "<P<S<M", "a" * 3, "\n" * 50, "(?:x){3}+\\E\\Q"]
    rows = [(k, t) for k, t in enumerate(texts * 12)]
    check_infill(rows, make(rows))


def test_infill_of_odd_rows(odd, clashing, empty):
    check_infill(ODD, odd)
    check_infill(ODD, clashing_with(clashing))
    assert infill.fill_in_middle(empty).count() == 0


def test_infill_of_a_very_long_text(make):
    rows = [(k, f"word{k} é, \n" * 250_000) for k in range(3)]
    check_infill(rows, make(rows))


# chat


CHAT = "conv_id long, turn long, role string, text string"


def chats(spark, rows):
    return spark.createDataFrame(rows, CHAT).repartition(3)


def check_chat(frame, rows):
    """Reads every conversation back from its chunks, and from the whole formatted text."""
    turns = brute.chat_turns(rows)
    chunks = chat.format_chunks(frame)
    got = {r[0]: r for r in read_conversations(chunks).collect()}
    assert set(got) == set(turns)
    found = chunks.withColumn("text", chat.formatted(F.col("segments"))).orderBy("conv_id", "chunk").collect()
    whole = {}
    for r in found:
        whole.setdefault(r.conv_id, []).append(r)
    for c, own in turns.items():
        said = "".join(f"{role or ''}\n{text}\n" for role, text in own)
        loss = "".join(text for role, text in own if role == "assistant")
        text = "".join(r.text for r in whole[c])
        assert tuple(got[c])[:6] == (c, len(own), sha(said), len(loss), sha(loss), len(text))
        flagged = [s.text for r in whole[c] for s in r.segments if s.loss]
        assert len(flagged) == sum(role == "assistant" for role, _ in own)
        _, odd, state = brute.chat_text(own)
        assert got[c].n_irregular == odd and whole[c][-1].last_state == state
    texts = frame.sparkSession.createDataFrame([(c, "".join(r.text for r in rs)) for c, rs in whole.items()], "conv_id long, text string")
    for r in texts.select("conv_id", chat.read_turns(F.col("text")).alias("turns")).collect():
        assert [tuple(t) for t in r.turns] == [(role or "", text) for role, text in turns[r.conv_id]]
    return whole


def test_chat_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", CONTROL_TEXT), (-1, 1, "assistant", CONTROL_TEXT)]
    check_chat(chats(spark, rows), rows)
    got = {r.conv_id: r for r in QUERIES["op13_chat_format"](spark, FOLDER).collect()}
    for c, own in brute.chat_turns(rows).items():
        assert got[c].turns_sha256 == sha("".join(f"{role}\n{text}\n" for role, text in own))
        loss = "".join(text for role, text in own if role == "assistant")
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), sha(loss))
        if c >= 0:
            assert got[c].formatted_chars == len(brute.chat_text(own)[0])


def test_chat_of_the_plain_format(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "hello"), (1, 3, "user", "bye")]
    whole = check_chat(chats(spark, rows), rows)
    assert whole[1][0].text == "<<SYS>>\nbe kind\n<</SYS>>\n<s>[INST] hi [/INST] hello</s><s>[INST] bye [/INST]"


def test_chat_of_irregular_orders_and_odd_values(spark):
    rng, rows = random.Random(4), []
    for c in range(60):
        for t in range(rng.randint(1, 9)):
            rows.append((c, rng.choice([t, t, 0, None]), rng.choice(["user", "assistant", "system", "tool", None, "", "[ROLE]x"]), rng.choice(["", None, "a", " b ", "c\n"])))
    rows += [(None, 0, "user", "no id"), (None, None, None, None), (0, -5, "assistant", "early"), (0, 2**40, "user", "late"), (7, 1, "user", "twice"), (7, 1, "user", "twice")]
    check_chat(chats(spark, rows), rows)
    check_chat(clashing_with(chats(spark, rows)), rows)


def test_chat_escapes_control_strings(spark):
    rng = random.Random(8)
    parts = [*chat.INSTRUCT.controls, "<", ">", "[", "]", "/", "\\", "s>", "SYS>>", "\\\\", " ", "\n", "$1", "x", "<\\s>", "INST]"]
    rows = [(c, t, ("user", "assistant")[t % 2], "".join(rng.choice(parts) for _ in range(rng.randint(1, 12)))) for c in range(300) for t in range(4)]
    whole = check_chat(chats(spark, rows), rows)
    for parts in whole.values():
        assert "".join(p.text for p in parts).count("</s>") == 2


def test_chat_of_a_long_conversation_is_cut_into_chunks(spark):
    rows = [(1, t, ("user", "assistant")[t % 2], f"turn {t}") for t in range(1000) if t != 300]
    rows += [(2, t, "assistant" if t % 3 else "user", "y" * t) for t in range(70, 200)] + [(3, 64, "user", "alone")]
    whole = check_chat(chats(spark, rows), rows)
    assert len(whole[1]) > 10 and len(whole[3]) == 1 and whole[3][0].alone


def test_chat_of_an_empty_table(spark):
    assert read_conversations(chat.format_chunks(chats(spark, []).limit(0))).count() == 0


def test_a_template_that_cannot_be_read_back_is_refused():
    def template(**changes):
        base = dict(
            states=("start", "a"), rules=(chat.Rule("start", "user", "<u>", "</u>", "a"),),
            controls=("<u>", "</u>", "<r>", "</r>"), spare=("<r>", "</r>", "</u>"), final=("a",),
        )
        return chat.Template(**{**base, **changes})

    template()
    for changes in (
        {"controls": ("<u>", "<u>x", "</u>", "<r>", "</r>")},
        {"controls": ("<u>", "</u>", "<r>", "</r>", "u><")},
        {"spare": ("<", "</r>", "</u>")},
        {"rules": (chat.Rule("start", "user", "<u>", " ", "a"),)},
        {"rules": (chat.Rule("start", "user", "<u>", "</u>", "a"), chat.Rule("a", "user", "<u>", "</r>", "a"))},
    ):
        with pytest.raises(ValueError):
            template(**changes)
