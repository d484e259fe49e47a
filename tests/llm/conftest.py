import random

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randint(0, 9)) for _ in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with every oddity: nulls, empty and long texts, repeats, ties, other scripts, clashing columns."""
    long = prose(1, 30_000)
    rows = [
        (1, prose(2, 200)), (2, prose(2, 200)), (3, prose(2, 200) + " end"), (4, ""), (5, None), (6, "   \n\t "), (7, long), (7, long),
        (None, prose(3, 60)), (None, prose(3, 60)), (None, None), (8, "中文字符 ñandú \U0001f642 <|endoftext|> a'll"), (9, "x"), (10, "a" * 20_000), (11, prose(4, 50) + "\n" + prose(2, 40)),
    ]
    rows = [(i, t, "en" if i and i % 2 else None, None, None) for i, t in rows]
    return spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS fp", "'x' AS th", "2 AS label", "'y' AS shard", "0.5 AS score", "'z' AS lang_pred", "3 AS start", "'k' AS key", "4 AS starts", "5 AS slot")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
