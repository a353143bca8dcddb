import random

from pyspark.sql import functions as F

from folioscope.llm.p4_scans import ScanParams, Vocabulary, body_lines, close, line_key, repaired, scan_noise, vocabulary_of

COUNTS = {w: n for w, n in {"the": 900, "room": 300, "archived": 200, "disagree": 150, "queue": 120, "reading": 150, "in": 500, "and": 400, "group": 90, "read-only": 60, "migrated": 40, "entries": 80, "bead": 30, "head": 90, "qa-0000": 300, "call": 90, "following": 90, "a": 300, "annotated": 60}.items()}
V = Vocabulary(COUNTS)


def test_misread_words_are_put_right():
    for bad, good in (("roorn", "room"), ("arcbived", "archived"), ("disaqree", "disagree"), ("qiieue", "queue"), ("ancl", "and"), ("ca1l", "call"), ("Tbe", "The"), ("QA-39Z8", "QA-3928"), ("QA-3S21", "QA-3521"), ("armotated", "annotated"), ("fo1lowing", "following")):
        assert V.correction(bad) == good, bad


def test_right_words_typing_errors_and_numbers_stay():
    for word in ("the", "bead", "raedings", "gruop", "3928", "QA-3928", "unknown", "x"):
        assert V.correction(word) is None, word


def test_furniture_counts_only_between_lines():
    headers = frozenset({line_key("Harbour plan BIN-6138")})
    text = "one line of\ntext that goes\n\nPage 3 of 48\n\x0c\nHARBOUR PLAN BlN-6138 | 2020-01-01\n\non and on"
    lines, n = body_lines(text, headers)
    assert n == 2 and "\n".join(lines) == "one line of\ntext that goes\non and on"
    assert body_lines("Harbour plan BIN-6138\none\ntwo\n12", headers)[1] == 0
    assert body_lines("a\n```\n12\n```\nb", headers)[1] == 0
    assert body_lines("a\n1\n2\n3\nb", headers)[1] == 0


def test_hyphens_and_compounds():
    h, m, f, text = repaired("the rea-\nding room and the read-\nonly queue, migra‐\nted entr¬\nies", frozenset(), V)
    assert (h, f) == (3, 0) and text == "the reading room and the read-only queue, migrated entries"


def test_keys_are_close_in_spite_of_misreading():
    assert close(line_key("Vaulf log DOC-7308"), line_key("VAULT LOG DOC-7308"))
    assert not close(line_key("Vault log DOC-7308"), line_key("the pilot continues unchanged"))


def test_sections(spark):
    base = "the group archived the queue and the head room in the reading room. " * 3
    rows = [(f"c{i}", 100 + i, base) for i in range(60)]
    noisy = "tbe group arcbived the qiieue\nin the rea-\nding roorn and the\nhead room"
    rows += [
        ("misread", 1, noisy), ("misread", 1, noisy), ("wrapped", 2, base.replace(" ", "\n", 9)), ("page", 3, "the group archived\n\n- 7 -\n\nthe queue"),
        ("header", 4, "the group archived\nLedger log REQ-1\nthe queue in the room"), ("few", 5, "the roorn and\nthe group"), ("null", 6, None), ("empty", 7, ""), (None, 8, noisy),
        ("repeat", 9, "the room\nSome running head\n12\nthe queue\nthe head\nSome runninq head\n13\nthe room"), ("long", 10, base * 3000), ("no doc", None, noisy),
    ]
    df = spark.createDataFrame(rows, "section_id string, doc_id bigint, text string").withColumns({"headers": F.lit("x"), "word": F.lit(1)})
    titles = spark.createDataFrame([(4, "Ledger log REQ-1"), (4, None), (3, ""), (None, "x")], "doc_id bigint, title string")
    got = {r.section_id: r for r in scan_noise(df, titles, ScanParams()).collect()}
    assert set(got) == {"misread", "page", "header", "repeat", "no doc"}
    assert got["misread"].repaired == "the group archived the queue in the reading room and the head room"
    assert got["page"].repaired == "the group archived the queue" and got["header"].n_furniture == 1 and got["repeat"].n_furniture == 4
    assert scan_noise(df.limit(0), titles.limit(0)).count() == 0


def test_numbers_that_are_no_page_numbers_stay():
    text = "The total was\n2024\nin the report\nand then\nB5\nwas chosen"
    assert body_lines(text, frozenset()) == (text.split("\n"), 0)
    assert body_lines(text.replace("\n2024\n", "\n\n2024\n\n"), frozenset())[1] == 0
    assert body_lines("one line\n12\nanother line", frozenset())[1] == 0
    assert body_lines("one line\n12\nanother line", frozenset(), rising=True) == (["one line", "another line"], 1)
    assert body_lines("one line\n\n12\n\nanother line", frozenset()) == (["one line", "another line"], 1)
    assert body_lines("one line\n12\n\x0c\nanother line", frozenset()) == (["one line", "another line"], 1)


def test_numbers_between_wrapped_lines_and_centred_ones_are_page_numbers():
    for number in ("19", "                    28"):
        text = f"the holiday period. No manual survey form was\n{number}\nannotated on the shared drive"
        assert body_lines(text, frozenset()) == (text.replace(f"{number}\n", "").split("\n"), 1)
    assert body_lines("these are the numbers of that evening:\n19\nand others", frozenset())[1] == 0
    assert body_lines("the holiday period. No manual survey form was\n2024\nannotated on the shared drive", frozenset())[1] == 0


def test_a_header_misread_each_time_and_a_sequence_of_numbers(spark):
    pages = ["the room\nRunning head of the archive desk\n- 1 -\nthe queue", "the head\nRunnjng head of the archive desk\n- 2 -\nthe room", "the head\nRunning head of fhe archlve dcsk\nthe room"]
    rows = [(f"h{i}", 1, i, x) for i, x in enumerate(pages)] + [(f"n{i}", 2, i, f"the room\n{i + 7}\nthe queue") for i in range(3)]
    rows += [(f"f{i}", 3, i, f"the room\n{n}\nthe queue") for i, n in enumerate((31, 12, 9))] + [("one", 4, 0, "the room\n7\nthe queue")]
    df = spark.createDataFrame(rows, "section_id string, doc_id bigint, section_order int, text string")
    got = {r.section_id: r.n_furniture for r in scan_noise(df, spark.createDataFrame([], "doc_id bigint, title string")).collect()}
    assert got == {"h0": 2, "h1": 2, "h2": 1, "n0": 1, "n1": 1, "n2": 1}


def test_a_word_beyond_the_vocabulary_is_not_taken_for_misread():
    assert Vocabulary({"modern": 900}).correction("modem") == "modern"
    assert Vocabulary({"modern": 900}, floor=100).correction("modem") is None
    assert Vocabulary({"modern": 9000}, floor=100).correction("modem") == "modern"


def test_the_vocabulary_is_whole_or_its_rarest_words_are_left_out(spark):
    df = spark.createDataFrame([("a a a a b b c d",), (None,), ("a b",)], "text string")
    assert vocabulary_of(df) == ({"a": 5, "b": 3, "c": 1, "d": 1}, 0)
    assert vocabulary_of(df, ScanParams(words=2)) == ({"a": 5, "b": 3}, 1)


def scans(seed):
    """Sections whose words have all counts from 1 on, with misread, hyphenated and numbered forms of frequent and rare ones."""
    rng, letters = random.Random(seed), "aeioudmnrlbhstcwg"
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(3, 8))) for _ in range(150)] + ["read-only", "qa-3928", "modern", "archived"]
    bad = [("m", "rn"), ("d", "cl"), ("u", "ii"), ("h", "b"), ("l", "1"), ("o", "0"), ("e", "c"), ("g", "9"), ("w", "vv")]

    def form(word):
        kind = rng.random()
        if kind < 0.08:
            x, y = rng.choice(bad)
            return word.replace(x, y)
        if kind < 0.13 and len(word) > 4:
            at = rng.randrange(2, len(word) - 1)
            return word[:at] + rng.choice("--\u00ad") + "\n" + word[at:].lstrip("-")
        return f"{word}-{rng.choice(words)}" if kind < 0.15 else word.replace("39", "3q") if kind < 0.3 else word

    pick = lambda: words[min(int(rng.paretovariate(0.5)) - 1, rng.randrange(len(words)))]
    return [(f"s{i}", i // 3, " ".join(form(pick()) for _ in range(rng.randrange(5, 80)))) for i in range(150)]


def test_words_that_are_not_sent_change_no_result(spark):
    titles = spark.createDataFrame([], "doc_id bigint, title string")
    rare = [("page", 900, "the rnodern\n- 3 -\nhall"), ("many", 901, "the modern hall " * 60), ("three", 902, "tbe rnodern hal1\nthe rnodern hall")]
    df = spark.createDataFrame([*scans(3), *rare], "section_id string, doc_id bigint, text string")
    whole = {r.section_id: tuple(r) for r in scan_noise(df, titles).collect()}
    assert whole["page"][2:] == (1, 1, "the modern hall") and len(whole) > 30
    for words in (0, 4, 40):
        assert vocabulary_of(df, ScanParams(words=words))[1] > 0
        assert {r.section_id: tuple(r) for r in scan_noise(df, titles, ScanParams(words=words)).collect()} == whole, words


def test_what_the_vocabulary_lacks_is_asked_and_answered():
    v = Vocabulary({"modern": 900}, floor=100)
    assert v.correction("modem") is None and v.asked == {"nmodem"}
    v.told = {"nmodem": (2, None), "lmodcrn": (0, None)}
    assert v.correction("modem") == "modern"
    v = Vocabulary({}, floor=100)
    assert v.correction("roorn") is None and v.asked == {"nroorn", "l" + "roorn"}
    v.told = {"nroorn": (1, None), "lroorn": (40, "room")}
    assert v.correction("Roorn") == "Room"
