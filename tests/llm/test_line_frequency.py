"""op13: counts, common lines and rejected documents against plain Python."""

import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string"


def normal(line):
    fold = lambda c: chr(ord(c) + 32) if "A" <= c <= "Z" else c
    return " ".join(WORD.findall("".join(map(fold, line))))


def expected(rows, limit=10):
    texts = defaultdict(set)
    for _, text, source in rows:
        for line in (text or "").split("\n"):
            if WORD.search(line):
                texts[source, normal(line)].add(text)
    out = []
    for doc_id, text, source in rows:
        text = text or ""
        words = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        seen = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
        repeats = {k + j for k in range(len(words) - 7) if seen[tuple(words[k : k + 8])] > 1 for j in range(8)}
        gone = [len(WORD.findall(x)) for x in lines if len(texts[source, normal(x)]) > limit]
        left, base = len(words) - sum(gone), len(words) < 20 or 100 * len(repeats) > 30 * len(words)
        kept = not base and left >= 5 and 100 * left >= 20 * len(words)
        out.append((doc_id, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeats), base, kept, len(lines), len(gone), left))
    return out


def judged(spark, rows, extra=None):
    from quarry.llm.line_frequency import judged

    frame = spark.createDataFrame(rows, SCHEMA)
    return [tuple(r) for r in judged(frame if extra is None else extra(frame)).drop("key", "removed").collect()]


def same(spark, rows):
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(judged(spark, rows), key=key) == sorted(expected(rows), key=key)


def prose(k, n=40):
    return " ".join(f"w{k}x{j}" for j in range(n))


def site(k, host):
    menu = "Home | About | Contact us\n%s by nobody" % ("Copyright" if k % 2 else " COPYRIGHT ")
    return (k, f"{menu}\n{prose(k) if k % 3 else prose(k, 12)}\n{prose(k + 10**6, 9)}", host)


def test_common_lines_of_a_host(spark):
    rows = [site(k, "a") for k in range(60)] + [site(1000 + k, "b") for k in range(5)]
    same(spark, rows)
    by_id = {r[0]: r for r in judged(spark, rows)}
    assert by_id[1][9] == 2 and by_id[1][7]  # both menu lines go, the document stays
    assert by_id[3][9] == 2 and by_id[3][7]
    assert by_id[1001][9] == 0  # five documents make no line of host b common


def test_copies_of_one_text_make_no_line_common(spark):
    rows = [(k, prose(1) + "\n" + prose(2), "a") for k in range(50)]
    same(spark, rows)
    assert all(r[7] for r in judged(spark, rows))


def test_depleted_documents_are_rejected(spark):
    rows = [(k, prose(1, 60) + "\n" + prose(100 + k, 9), "a") for k in range(30)] + [(99, prose(7), "a")]
    same(spark, rows)
    assert {r[0] for r in judged(spark, rows) if r[7]} == {99}


def test_nulls_repeats_ties_and_strange_texts(spark):
    odd = "  \n\t\n\x0b\f\r\nA\xa0b é９ #*$%&|<> x\r\nA\xa0b é９ #*$%&|<> x\r\na\xa0B é９ #*$%&|<> x"
    rows = [(1, None, "a"), (2, "", None), (None, odd, None), (None, odd, None), (3, " ".join(["same"] * 60), "a"), (4, (prose(3, 9) + " ") * 5, "a"), (4, (prose(3, 9) + " ") * 5, "b"), (5, "long " * 300_000 + "\n" + prose(8), "a")]
    rows += [(None, f"menu line\n{prose(k)}", None) for k in range(20)] * 2
    same(spark, rows)


def test_empty_and_clashing_columns(spark):
    from pyspark.sql import functions as F

    from quarry.llm.line_frequency import cleaned

    assert judged(spark, []) == []
    assert cleaned(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [site(k, "a") for k in range(30)]
    extra = lambda df: df.select("*", F.lit(1).alias("key"), F.lit("x").alias("host"), F.lit(2).alias("removed"), F.lit(3).alias("row"))
    assert sorted(judged(spark, rows, extra)) == sorted(expected(rows))
    out = cleaned(extra(spark.createDataFrame(rows, SCHEMA)))
    assert out.columns == ["doc_id", "text", "source", "key", "host", "removed", "row"]
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    want = {r[0]: "\n".join(r[1].split("\n")[2:]) for r in rows if {x[0]: x[7] for x in expected(rows)}[r[0]]}
    assert texts == want
