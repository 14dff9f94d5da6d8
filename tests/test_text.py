import unicodedata

from pyspark.sql import functions as F

from citegrain.functions import headings, numbers, questions, text


def test_tokens_keep_compounds_and_their_parts(each):
    assert each(text.tokens, ["BERT-base v1.5, 신뢰도 a/b"]) == [
        ["bert-base", "bert", "base", "v1.5", "v1", "5", "신뢰도", "a/b", "a", "b"]
    ]
    assert each(text.tokens, ["the the"]) == [["the", "the"]]


def test_shingles_and_jaccard(each):
    shingle = lambda c: text.shingles(text.plain_tokens(c))
    assert each(shingle, ["a b c d", "a b", ""]) == [["a b c", "b c d"], ["a", "b"], []]
    similar = lambda a, b: text.jaccard(shingle(a), shingle(b))
    assert each(similar, [("a b c d", "a b c e"), ("", ""), ("", "a")]) == [1 / 3, 1.0, 0.0]


def test_fact_tokens(each):
    found = each(text.fact_tokens, ["ResNet-50 needs 12 ms, not 15%, at most 3 GBs"])[0]
    assert {"ResNet-50", "12", "12ms", "not", "15%", "at most", "3"} <= set(found)
    assert "3gb" not in found
    assert found == sorted(found)


def test_clean_and_merge(each):
    assert each(text.clean_text, ["inter-\nnational  co­op\n x "]) == ["international coop x"]
    left, right = "x" * 10 + "The shared passage is long.", "The shared passage is long. More."
    assert each(text.merge_overlap, [(left, right), ("ab", "cd")]) == [left + " More.", "ab\ncd"]


def test_occurrences_give_every_match_with_its_surroundings(each):
    windows = lambda c: text.occurrences(c, "ab+", 3, 2)
    found = each(windows, ["xxabbyyabzz ab", "none"])
    assert [tuple(w) for w in found[0]] == [
        ("xx", "abb", "yy"), ("byy", "ab", "zz"), ("zz ", "ab", ""),
    ]
    assert found[1] == []


def test_nfkc(each):
    assert each(text.nfkc, ["ﬁne ①"]) == [unicodedata.normalize("NFKC", "ﬁne ①")]


def test_headings(each):
    lines = {
        "Abstract: we study": "Abstract",
        "IV. RELATED WORK": "IV. RELATED WORK",
        "2.1 Model Architecture": "2.1 Model Architecture",
        "1.INTRODUCTION": "1.INTRODUCTION",
        " Conclusions ": "Conclusions",
        "References.": None,
        "Appendix B": "Appendix B",
        "3 Results, and more": None,
        "12 Jan 2020": None,
        "2 What is new here": None,
        "1 University of Somewhere": None,
        "4 Speed = fast": None,
        "0.95 0.87 0.66": None,
        "An ordinary sentence": None,
        "ab": None,
    }
    assert each(headings.heading, list(lines)) == list(lines.values())


def test_columns_and_footnotes(each):
    wide = "\n".join(["left    right"] * 2 + ["one column"] * 4)
    assert each(lambda c: headings.two_columns(headings.lines(c)), [wide, "a    b"]) == [True, False]
    notes = "1 see the appendix\n* equal share\n2.1 Model Architecture\nplain"
    assert each(lambda c: headings.footnote_count(headings.lines(c)), [notes]) == [2]


def test_question_kinds(each):
    asked = {
        "Why does it fail?": ["causal"],
        "List the datasets": ["list"],
        "Which three methods differ?": ["comparison", "list"],
        "정확도는 얼마인가?": ["numeric"],
        "한계는 무엇인가?": ["limitations"],
        "재정의된 모델": [],
        "Hello there": [],
    }
    assert each(questions.kinds, list(asked)) == list(asked.values())


def test_question_parts(each):
    rows = each(
        questions.parts,
        ["What is the loss and how is it trained?", "Compare speed and accuracy results", "Hi?"],
    )
    assert [p.request for p in rows[0]] == ["What is the loss", "how is it trained"]
    assert rows[0][1].query == "What is the loss; how is it trained"
    assert [p.request for p in rows[1]] == ["Compare speed", "accuracy results"]
    assert [p.request for p in rows[2]] == ["Hi?"]


def test_selector_query_adds_hints(each):
    ask = lambda q: questions.selector_query(q, questions.kinds(q), questions.asked_terms(q))
    plain, korean = each(ask, ["Name it", "학습률은 얼마인가"])
    assert plain == "Name it"
    assert "learning rate" in korean and "reported result" in korean


def test_numbers():
    cases = {
        "1.0 and 1,000": {"1", "1000"},
        "1e-3 or −2.50": {"0.001", "-2.5"},
        "3 million users, 12%": {"3000000", "12%"},
        "5x faster, 2-fold": {"5x", "2x"},
        "3만 명": {"30000"},
        "7 percent": {"7%"},
        "lasted a decade": {"10"},
        "1e99": {"1e99"},
    }
    for given, expected in cases.items():
        assert numbers.number_set(given, False) == expected, given
    assert numbers.number_set("three of ten", True) == {"3", "10"}


def test_units_and_bounds():
    assert numbers.unit_set("12 ms and 3.0 GB, 4초") == {("12", "ms"), ("3", "gb"), ("4", "s")}
    assert numbers.bound_list("at least 5 ms and below 10%", False) == ["10%||lt", "5|ms|ge"]
    assert numbers.bound_list("5밀리초 이상, 10% 미만", True) == ["10%||lt", "5|ms|ge"]
    assert numbers.bound_list("0 < T", False) == ["0||gt"]


def test_numbers_are_tried_around_digits_only():
    texts = [
        "12 ms, a5.7 b.5 <-3 >= .5 1e-5x 3 million 4 만 x9", "at most 5 up to  6GB below. 7 no less than −8%, BELOW\n9 less than ten",
        "5 < n 6 ≥ α 7이하 8 보다 작 최대 9 최소 -1 넘는 2 까지", "٣ ms 1.2.3,4 5 x 5x--6 .7.8 +.9e+1 12345 이상", "no digits, at most", "",
    ]
    forms = [(form, leads) for told in numbers.BOUND_FORMS.values() for form, _, leads in told]
    for form, leads in [*forms, (numbers.SCALED, ()), (numbers.STATED, ()), (numbers.MEASURED, ())]:
        for given in texts:
            found = numbers.found_at(form, given, numbers.digits_of(given), leads)
            assert [m.span() for m in found] == [m.span() for m in form.finditer(given)], (form, given)
        assert not list(numbers.found_at(form, "never tried 5", [], leads))
    assert numbers.number_set("ONE, two-ſix, often tenth 3rd ten_ ﬁve é eight", True) == {"1", "2", "3", "6", "8"}


def test_number_columns(each):
    assert each(lambda c: numbers.numbers(c, words=False), ["2 and 2.0", None]) == [["2"], []]
    assert each(numbers.units, ["3 GB"]) == [["3 gb"]]
    assert each(lambda c: F.size(numbers.bounds(c)), ["up to 3 GB"]) == [1]


def test_token_list_equals_the_column(each):
    rows = ["", "One two-three a.b/c x_", "Kelvin İstanbul-x 3.5GB", "한글abc-1 가나 -- a- -b", "plain words", "ΑΣ. a--b e_f"]
    assert [text.token_list(row) for row in rows] == each(text.tokens, rows)


def test_headings_of_a_text_equal_those_of_its_lines(spark):
    heads = ["1 Introduction", " :II. METHODS AND DATA", "\t Abstract: we show", "APPENDIX b", "2.RESULTS AND OUTLOOK", "Related  Work."]
    rows = [(n, end.join(["Some prose here.", head, "More prose, of 1 line"])) for n, (head, end) in enumerate(
        # the point keeps the last one from being a heading
        (head, end) for head in heads for end in ("\n", "\r\n", "\x0b", " ", "\n\n")
    )] + [(900, "no heading\nat all"), (901, heads[0])]
    df = spark.createDataFrame(rows, "n int, t string").withColumn("lines", headings.lines(F.col("t")))
    got = df.select(
        "n", F.coalesce(headings.headings(F.col("t"), F.col("lines")), F.transform("lines", lambda _: F.lit(None))).alias("a"),
        F.transform("lines", lambda raw: headings._title(F.regexp_replace(text.squeeze(raw), "^[ :\t]+|[ :\t]+$", ""))).alias("b"),
    ).collect()
    assert all(r.a == r.b for r in got) and sum(any(r.a) for r in got) == 26
