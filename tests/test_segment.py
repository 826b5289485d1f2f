import pytest

from lumora.operators import paper, segment

CASES = {
    "parts": ("9. Intro nine\na) first part\nb) second part\n10. Ten text", {"9": "Intro nine", "9a": "first part", "9b": "second part", "10": "Ten text"}),
    "none": ("unnumbered text only", {"1": "unnumbered text only"}),
    "bullets": ("1. one\n2. two\n3. three\n4. four\n5. five\n6. six\n7. seven\n1) bullet one\n2) bullet two", {"1": "one", "2": "two", "3": "three", "4": "four", "5": "five", "6": "six", "7": "seven 1 bullet one 2 bullet two"}),
    "preamble": ("Preamble that is long enough\n2. two", {"1": "Preamble that is long enough", "2": "two"}),
    "roman": ("i) Roman numeral one.", {"1": "i) Roman numeral one."}),
    "forms": ("02. zero two\nQ2. again\n(3) three\nAns 4. four\nQuestion 5: five", {"2": "zero two again", "3": "three", "4": "four", "5": "five"}),
    "line": ("Q1. Answer one. Q2. Answer two.", {"1": "Answer one. Q2. Answer two."}),
    "null": (None, {}),
    "blank": ("   ", {}),
    "range": ("1. one\n77. lost\n2. two", {"1": "one", "2": "two"}),
}


@pytest.fixture(scope="module")
def found(spark):
    rows = segment.segment(spark.createDataFrame([(k, v[0]) for k, v in CASES.items()], "doc_id string, text string")).collect()
    return {k: {r.q_key: r.text for r in rows if r.doc_id == k} for k in CASES}


@pytest.mark.parametrize("case", CASES)
def test_segments(found, case):
    assert found[case] == CASES[case][1]


def test_expected_keys_and_fallback(spark):
    t = spark.createDataFrame([("g", "Q2. list\na) one x\nb) two y\nQ3. three\n9. nine\na) nine a\nb) nine b"), ("f", "Answer for question 1 text here.\n\nSecond paragraph with text enough.\n\nThird paragraph with text too.")], "doc_id string, text string")
    e = spark.createDataFrame([("g", ["2", "3", "9", "9a", "9b"]), ("f", ["1", "2", "3"])], "doc_id string, q_keys array<string>")
    rows = segment.segment_with_fallback(t, e).collect()
    got = {(r.doc_id, r.q_key): r.text for r in rows}
    assert ("g", "2a") not in got and got["g", "9a"] == "nine a" and got["g", "2"].startswith("list")
    assert got["f", "1"].startswith("Answer for question 1") and got["f", "2"].startswith("Answer") and got["f", "3"].startswith("Second")
