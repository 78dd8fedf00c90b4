import random
import re

from pyspark.sql import functions as F

from gleanery.llm.personal_data import KINDS, _candidates, _clean, base_spans, find_personal_data

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(d) * (1 + k % 2) for k, d in enumerate(reversed(digits))]
    return sum(x - 9 * (x > 9) for x in doubled) % 10 == 0


def brute(text):
    found = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            valid = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")),
                "card": 13 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }
            if valid[kind]:
                found.append((kind, m.start(), m.end()))
    return found


def test_base_spans_equal_the_plain_expressions(spark):
    rng = random.Random(5)
    texts = [
        None, "", "a@b.c_x@y.z@q.r", "x" * 2000 + "@", "a@b..c", "é😀 a@b.co 1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.004",
        "4111 1111 1111 1111 4111-1111-1111-1111 4111--1111", "+1 (555) 010-0199 ", "+1.2.3.4.5.6.7.8.9)", "\x01a@b.c\x02 1.1.1.1",
        "a@b.c" * 300, "0" * 2000 + " 1.2.3" + ".4" * 3000, "+" + "1 " * 40 + "+12345678901", "a@" + "b." * 2000 + "c",
        *("".join(rng.choice("ab1.@-+ ()%_9é") for _ in range(60)) for _ in range(1500)),
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    clean = _clean(F.col("text"))
    for r in rows.select("doc_id", *(base_spans(clean, k).alias(k) for k in KINDS)).collect():
        got = [(k, s["start"], s["end"]) for k in KINDS for s in r[k]]
        assert got == brute(texts[r["doc_id"]]), texts[r["doc_id"]][:100]


def test_very_long_texts_take_linear_time(spark):
    texts = ["x" * 300_000 + "@", "0" * 300_000, "1." * 100_000, "a@" + "b." * 100_000 + "c", "1 " * 100_000, "+1" * 100_000]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: [tuple(s) for s in r["base"]] for r in find_personal_data(rows).collect()}
    assert found[0] == found[1] == found[4] == found[5] == []
    assert len(found[2]) == 25_000 and found[3] == [(0, 0, 200_003)]


def test_contexts_of_seeds_find_further_identifiers(spark):
    rows = [(i, f"please mail address: user{i}@example.com thanks") for i in range(20)]
    rows += [(100 + i, f"ä please mail address: user{i}_at_home{i}789 thanks 2024") for i in range(3)]
    rows += [(200 + i, f"the year was 2024{i} as said") for i in range(9)]
    found = {r["doc_id"]: r for r in find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        added = [(s["kind"], text[s["start"] : s["end"]]) for s in found[i]["added"]]
        assert added == ([(0, text.split()[4])] if 100 <= i < 200 else [])
        assert len(found[i]["base"]) == (i < 100)


def candidates(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = rows.select("doc_id", _clean(F.col("text")).alias("text"))
    base = F.flatten(F.array(*(base_spans(F.col("text"), k) for k in KINDS)))
    found = rows.select("doc_id", "text", _candidates(F.col("text"), base).alias("c")).orderBy("doc_id").collect()
    for r in found:
        assert all(r["text"][s["start"] : s["end"]] == s["value"] for s in r["c"])
    return [[(s["value"], s["before"]) for s in r["c"]] for r in found]


def test_candidates_before_the_end_of_a_sentence(spark):
    texts = ["call 5551234567. Then", "call 5551234567!", "call 5551234567 now", "mail bob@host. Then", "is it AB-1234?! No", "in 2024. So", "é id x.1234..."]
    values = [[v for v, _ in found] for found in candidates(spark, texts)]
    assert values == [["5551234567"], ["5551234567"], ["5551234567"], ["bob@host"], ["AB-1234"], [], ["x.1234"]]
    rows = [(i, f"please mail address: user{i}@example.com thanks") for i in range(20)]
    rows += [(20, "please mail address: user_at_home1789. Thanks")]
    found = {r["doc_id"]: r for r in find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [tuple(s) for s in found[20]["added"]] == [(0, 21, 37)]


def test_groups_of_digits_are_one_candidate(spark):
    expected = {
        "my phone 555 123 4567 now": [("555 123 4567", "my phone ")],
        "phone (555) 123-4567. Then": [("(555) 123-4567", "phone ")],
        "(phone 555.123.4567) tel(555)123-4567": [("555.123.4567", "(phone "), ("(555)123-4567", ") tel")],
        "(555 123 4567) 1)555-(123)-4567, 12 345": [("555 123 4567", "("), ("555-(123)-4567", ")"), ("12 345", ", ")],
        "card 4111 1111 1111 1112!": [("4111 1111 1111 1112", "card ")],
        "555 123 4567x9 (0)20 1234-x": [("555 123", ""), ("4567x9", " "), ("1234-x", " ")],
        "at 10.0.0.1 5551234567": [("5551234567", "at 00.0.0.0 ")],
        "4111 1111 1111 1111 (555) 123-4567": [("(555) 123-4567", "0000 0000 0000 0000 ")],
        "+1 555 010 0199 is base, +12 345 67 not, 555  1234 not": [("+12 345 67", " is base, ")],
        "in 2024 we": [],
    }
    for text, found in zip(expected, candidates(spark, list(expected))):
        assert found == expected[text], text
    long = ["1(" * 50_000 + "1x", "1(1)" * 50_000 + "x", "1-(" * 50_000, "1 (1) " * 50_000 + "1x", "(1.1-" * 50_000, "1.2.3.4 555 12" * 5_000]
    assert len(candidates(spark, long)) == len(long)


def test_groups_behind_patterns_are_added(spark):
    rows = [(i, f"my phone number +1 555 010 {1000 + i} thanks") for i in range(20)]
    rows += [(20, "my phone number 555 123 4567. Thanks"), (21, "my phone number (555) 123-4567, thanks")]
    found = {r["doc_id"]: r for r in find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [tuple(s) for s in found[20]["added"]] == [(3, 16, 28)]
    assert [tuple(s) for s in found[21]["added"]] == [(3, 16, 30)]


def test_discovered_identifiers_induce_patterns(spark):
    rows = [(i, f"please mail address: user{i}@example.com thanks") for i in range(20)]
    rows += [(100 + i, f"please mail address: user_at_home{i}789 thanks") for i in range(6)]
    rows += [(200 + i, f"or write towards user_at_home{i}789 thanks") for i in range(6)]
    rows += [(300, "or write towards someone_at_work1234 thanks"), (301, "or read page someone_1234 thanks")]
    found = {r["doc_id"]: r for r in find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [tuple(s) for s in found[300]["added"]] == [(0, 17, 36)]
    assert found[301]["added"] == []


def test_odd_rows(odd_docs, no_docs):
    assert find_personal_data(odd_docs).count() == odd_docs.count()
    assert find_personal_data(no_docs).count() == 0
