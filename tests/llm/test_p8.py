import re

import pytest
from pyspark.sql import functions as F

from folioscope.llm.p8_encoding import ODD_WORD, corpus_model, odd_word_counts, odd_words, repair, restored

CLEAN = [
    "Le comité a relevé 9643 pièces à la côte est, dès la première séance près du théâtre.",
    "Die Übersetzungsgruppe übernahm am Prüfstand fünf Einträge für das Gerätebuch, gemäß Größe.",
    "El área técnica añadió la página según la petición económica en la región montañosa.",
    "A seção técnica então reabriu a avaliação não concluída; ATENÇÃO: peças órfãs no balcão.",
    "Группа приёма описала общую таблицу сразу после полуночи, комиссия проверила журнал.",
    "Służba nocna przedłużyła protokół ważenia w ciągu dwóch dni, zob. półrocza częściej.",
    "The café’s naïve résumé cost €120 – “read-only” at best… ±5 °C.",
]


def corpus(spark, extra):
    rows = [(i, CLEAN[i % 7]) for i in range(700)] + extra
    return spark.createDataFrame(rows, "id bigint, text string").withColumns({"word": F.lit(1), "n": F.lit("x"), "restored": F.lit(1)})


def wrong(text, right, assumed, times=1):
    for _ in range(times):
        text = "".join(bytes([b]).decode(assumed, "ignore") or chr(b) for b in text.encode(right))
    return text


CASES = [(0, "utf-8", "cp1252", 1), (1, "utf-8", "cp1252", 2), (2, "utf-8", "mac_roman", 1), (3, "utf-8", "cp850", 1), (4, "utf-8", "cp1252", 1), (4, "cp1251", "latin-1", 1), (4, "koi8-r", "cp1251", 1), (5, "utf-8", "cp1251", 1), (1, "cp1252", "cp437", 1), (6, "utf-8", "cp437", 1)]


def test_texts_come_back(spark):
    extra = [(1000 + i, wrong(CLEAN[c], right, assumed, times)) for i, (c, right, assumed, times) in enumerate(CASES)]
    extra += [(2000, None), (2001, ""), (2002, "plain"), (2003, "only one cafÃ© here"), (2004, CLEAN[2].replace("á", "�").replace("ó", "�").replace("ñ", "�")), (None, extra[0][1]), (2005, (CLEAN[0] + " ") * 3000), (1000, extra[0][1])]
    got = {r.id: r for r in restored(corpus(spark, extra)).collect()}
    assert set(got) == {1000 + i for i in range(len(CASES))} | {2004}
    for i, (c, right, assumed, _) in enumerate(CASES):
        assert got[1000 + i].restored == CLEAN[c], (right, assumed)
    assert got[2004].restored == CLEAN[2]
    assert restored(corpus(spark, []).limit(0)).count() == 0


def test_entities_of_garbled_characters(spark):
    garbled = "der Pr&Atilde;&frac14;fstand und f&#195;&#188;nf Eintr&#xC3;&#xA4;ge am Tor"
    rows = [(1000, garbled), (1001, "f&uuml;nf Eintr&auml;ge f&#252;r R&amp;D &lt;b&gt; &nosuch; & ; &;"), (1002, "one gem&Atilde;&curren;&Atilde;&#159; only")]
    got = {r.id: (r.n_garbled, r.restored) for r in restored(corpus(spark, rows)).collect()}
    assert got == {1000: (3, "der Prüfstand und fünf Einträge am Tor")}


@pytest.fixture(scope="module")
def model(spark):
    return corpus_model(odd_word_counts(corpus(spark, [])))


def test_clean_words_stay(model):
    for text in [*CLEAN, "NÃO ATENÇÃO Âge CÂMARA È À Á œuvre ¿qué? «oui»", "a–b — ‘x’"]:
        for word in odd_words(text):
            assert repair(word, model) == (word, ()), word


def test_words_are_split_at_ascii_blanks_only():
    for text in ["aé\xa0b cÂ\x85d e\0fü \tgö", "é", "", "abc", "Ã\xa0 x"]:
        assert odd_words(text) == ODD_WORD.findall(text) == [w for w in re.split(r"[\x00-\x20]+", text) if not w.isascii()]
