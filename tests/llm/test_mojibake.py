"""Garbled text: what is found, what is restored, and what must be left alone."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandline.llm import mojibake as M

CLEAN = [
    "Die Antwort lässt sich nicht bestätigen, sagt die Gärtnerin in der Küche.", "A opção C é a única que não contradiz o vídeo: NÃO HÁ MAÇÃ.", "Ответ нельзя определить без отрезка.", "画面里没有出现纸船，因此应当回答无法判断。",
    "フレームが足りないため、判断できません。", "It’s a “café” – naïve…", "Część klatek została usunięta.", "¡Cuidado! ¿Por qué la panadera levantó el cajón?", "EYE CHART: Ã Â Ä Å Ç É Ñ Õ ß Ð Ý", "Țara și orașul apar pe hartă.",
    "Ђак и учитељ љуљају њену чамац.", "“CAPITÔ", "Î, Ï and Ô are on three cards.", "Price £2 – ¥400, 20 °C", "", "plain", None,
]
GARBLED = [
    ("bestätigen lässt", "utf-8", "cp1252"), ("não opção", "utf-8", "latin-1"), ("Ответ нельзя", "utf-8", "cp1251"), ("画面里没有出现纸船，因此应当回答无法判断。", "utf-8", "cp437"), ("lässt bestätigen", "cp1252", "mac_roman"),
    ("нельзя определить", "cp1251", "latin-1"), ("画面里没有出现纸船，因此应当回答无法判断。", "gb18030", "latin-1"), ("Część klatek usunięta", "utf-8", "cp1250"), ("20 °C", "utf-8", "cp1252"), ("naïve café", "utf-8", "mac_roman"),
]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x", "y", 1) for i, t in enumerate(texts)], "doc_id bigint, text string, word string, chain string, n int")


def corpus():
    return CLEAN * 12  # every clean word in several documents


def test_found_and_restored(spark):
    garbled = [t.encode(a).decode(b, "replace") for t, a, b in GARBLED]
    df = frame(spark, corpus() + garbled)
    first = len(corpus())
    assert sorted({r.doc_id for r in M.find_garbled(df, "doc_id", "text").collect()}) == list(range(first, first + len(garbled)))
    got = {r.doc_id: r for r in M.restore(df, "doc_id", "text").collect()}
    for i, (t, _, _) in enumerate(GARBLED):
        assert got[first + i].restored == t and got[first + i].complete


def test_lost_characters_are_found_and_kept(spark):
    lost = "Die Antwort lässt".encode("cp1252").decode("utf-8", "replace")
    df = frame(spark, [*corpus(), lost, "画面".encode("gb18030").decode("utf-8", "replace")])
    got = {r.doc_id: r for r in M.restore(df, "doc_id", "text").collect()}
    first = len(corpus())
    assert sorted(got) == [first, first + 1] and not got[first].complete and got[first].restored == lost


def test_twice_garbled(spark):
    twice = "naïve".encode().decode("cp1252").encode().decode("cp1252")
    got = {r.doc_id: r for r in M.restore(frame(spark, [*corpus(), twice]), "doc_id", "text").collect()}
    assert list(got) == [len(corpus())] and got[len(corpus())].restored == "naïve"


def test_words_the_corpus_never_holds_clean_are_cut_into_characters(spark):
    text = "船纸断判".encode().decode("latin-1")
    got = {r.doc_id: r for r in M.restore(frame(spark, [*corpus(), text]), "doc_id", "text").collect()}
    assert list(got) == [len(corpus())] and got[len(corpus())].restored == "船纸断判"


def test_long_text_and_empty_table(spark):
    long = "lÃ¤sst " + "x" * 300_000 + "é" * 20_000
    got = M.find_garbled(frame(spark, [*corpus(), long]), "doc_id", "text").collect()
    assert {(r.doc_id, r.word) for r in got} == {(len(corpus()), "lÃ¤sst")} | {(r.doc_id, r.word) for r in got if "Ã¤" in r.word}
    assert M.find_garbled(frame(spark, []), "doc_id", "text").collect() == []
    assert M.restore(frame(spark, [None, ""]), "doc_id", "text").collect() == []


def test_repeated_keys_are_one_document(spark):
    df = spark.createDataFrame([(1, t) for t in corpus() if t] + [(2, "lÃ¤sst"), (2, "lÃ¤sst"), *((k, "lässt") for k in range(10, 20))], "doc_id bigint, text string")
    assert {r.doc_id for r in M.find_garbled(df, "doc_id", "text").collect()} == {2}


@pytest.mark.parametrize("word", ["lässt", "画面里", "Ответ", "’", "a"])
def test_forms_say_what_can_be_undone(word):
    for form, (chain, lossless) in M.garbled_forms(word).items():
        assert form != word and not form.isascii()
        steps = chain.split(">")
        if lossless and len(steps) == 2:
            assert M._encode(form, steps[1]).decode(steps[0]) == word


def test_copies_of_a_garbled_text_count_once(spark):
    text = "нельзя определить без отрезка".encode("koi8-r").decode("cp1251")
    clean = [f"Ответ нельзя определить без отрезка {i}" for i in range(6)]
    df = frame(spark, clean + [text] * 5 + [f"{text} {clean[0].split()[0]}"])
    assert sorted({r.doc_id for r in M.find_garbled(df, "doc_id", "text").collect()}) == list(range(6, 12))


def test_several_words_of_one_text_are_evidence_without_a_ratio(spark):
    pairs = [("Нельзя Определить", "koi8-r", "cp1251"), ("lässt bestätigen", "cp1252", "mac_roman"), ("Część została usunięta", "cp1250", "ansi")]
    clean = [t for t, _, _ in pairs]
    garbled = [M._decode(t.encode(a), b, "replace") for t, a, b in pairs]
    got = {r.doc_id: r.restored for r in M.restore(frame(spark, clean + garbled), "doc_id", "text").collect()}
    assert got[3] == clean[0] and got[4] == clean[1] and not {0, 1, 2} & set(got)


def test_short_legacy_forms_with_a_clear_ratio(spark):
    clean = [f"Day {i}: 20 °C" for i in range(220)] + [f"Он {i} на лодке" for i in range(220)] + ["ОБ этом на лодке", "У 20"]
    garbled = ["25 °C;".encode("mac_roman").decode("latin-1"), "20 °C".encode("cp1252").decode("mac_roman")]
    got = {r.doc_id: r.restored for r in M.restore(frame(spark, clean + garbled), "doc_id", "text").collect()}
    assert got == {442: "25 °C;", 443: "20 °C"}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("aB1é5ßЖдя画面ｱ船“–°ÿ퟿", min_size=1, max_size=6), min_size=1, max_size=8, unique=True))
def test_forms_of_many_words_are_those_of_each(words):
    words = [w for w in words if not w.isascii()]
    every, lossy = M.held_forms(words, lambda h: np.ones(len(h), dtype=bool))
    want = {(i, form, *how) for i, w in enumerate(words) for form, how in M.garbled_forms(w).items()}
    assert set(every) == want and (lossy is not None) == any(M.LOST in f for _, f, _, _ in want)
    few = {int(M.hashes(f.encode())[0][0]) for _, f, _, _ in list(want)[::3]}
    some, _ = M.held_forms(words, lambda h: np.isin(h, list(few)))
    assert set(some) == {x for x in want if int(M.hashes(x[1].encode())[0][0]) in few}


def test_runs_are_garbled_again():
    text = "船纸断判"
    assert M.garbles_to(text, "utf-8>latin-1", text.encode().decode("latin-1")) and not M.garbles_to(text, "utf-8>latin-1", text.encode().decode("latin-1")[:-1])
    assert not M.garbles_to("x", "utf-8>latin-1 without controls", "x")
