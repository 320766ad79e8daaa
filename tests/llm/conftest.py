import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, size long"


@pytest.fixture(scope="session")
def texts():
    """Own small corpus: words of two vowel habits, copies, near copies, a long text, oddities."""
    r = random.Random(11)
    words = {"aa": ["".join(r.choice("bdgk") + r.choice("aei") for _ in range(r.randint(1, 4))) for _ in range(150)], "oo": ["".join(r.choice("lmnp") + r.choice("ouy") for _ in range(r.randint(1, 4))) for _ in range(150)]}
    rows = []
    for k in range(120):
        lang = ("aa", "oo")[k % 3 == 0]
        text = " ".join(r.choice(words[lang]) for _ in range(r.randint(3, 120)))
        rows.append((3 * k, text, lang, ("s1", "s2", "s3", None)[min(k % 7, 3)]))
    for k in range(15):
        rows.append((1000 + k, rows[k][1], rows[k][2], "s1"))
        changed = rows[k + 20][1].split(" ")
        changed[len(changed) // 2] = "changed"
        rows.append((1100 + k, " ".join(changed), rows[k + 20][2], "s2"))
    rows += [(2000, None, "aa", "s1"), (2001, "", None, None), (2002, "  \t\n ", "oo", "s2"), (2003, "12 34", "aa", "s1"), (2004, " ".join(r.choice(words["aa"]) for _ in range(9000)), "aa", "s3"), (2005, "naïve Ünïcode ß 𝄞 x", "oo", "s1")]
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, lang, s, None, "x", 7) for i, t, lang, s in texts], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd(spark):
    """Repeated rows, null ids and null columns only."""
    rows = [(1, "one two three four", "aa", "s1"), (1, "one two three four", "aa", "s1"), (None, "one two three four", None, None), (None, None, None, None), (2, None, None, None)]
    return spark.createDataFrame([(i, t, lang, s, None, None, None) for i, t, lang, s in rows], SCHEMA)
