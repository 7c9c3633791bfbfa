import random

import pytest

LONG = "DOC_ID LONG, text STRING, lang STRING, source STRING, n_chars LONG"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randint(0, 60)) for _ in range(n))


def odd_texts() -> list[tuple]:
    """(doc_id, text): nulls, empty and very long texts, ties, repeated rows, copies, near copies and shared passages."""
    base, shared = prose(1, 200), prose(2, 60)
    near = base.split()
    near[100] = "changed"
    nearer = list(near)
    nearer[10] = "other"
    rows = [
        (0, base),
        (1, None),
        (2, ""),
        (3, " \n\t\n "),
        (4, base),  # a copy
        (5, " ".join(near)),
        (6, " ".join(nearer)),
        (7, base.upper().replace(" ", "\n")),  # the same words in other dress
        (8, "one two"),
        (9, "One Two"),
        (10, "one"),
        (11, prose(3, 30) + "\n" + shared + "\n" + prose(4, 80)),
        (12, prose(5, 10) + "\n" + shared + "\n\n" + prose(6, 90) + "\n" + shared),
        (13, "ab" * 400),
        (14, "a" * 3000),
        (15, "été où " * 70 + "日本語テキスト " * 30),
        (16, "x |y #z " * 60),
        (17, prose(7, 20000)),  # very long
        (18, prose(8, 120)),
        (18, prose(9, 120)),  # one id, two texts
        (19, prose(10, 120)),
        (19, prose(10, 120)),  # a repeated row
        (None, prose(11, 120)),
        (None, None),
        (21, prose(11, 120)),
        (22, "line of words that is long enough to count here as a run of more than twenty words in all of its long length\n" * 3),
        (23, "short\nlines\nonly\n" * 12),
        (24, "short\nlines\nonly\n" * 12 + "end"),
        (25, "I don't say <|endoftext|> or </s>[INST] \\[x] <s>  'll   ok\r\n\x0b\x0c!"),
    ]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    """The odd texts with the columns of documents and some whose names may clash."""
    rows = [(i, t, "en" if (i or 0) % 2 else None, "s", len(t or ""), 7, "k", 1, None) for i, t in odd_texts()]
    extra = "n_words LONG, key STRING, component_id INT, rank STRING"
    return spark.createDataFrame(rows, f"doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG, {extra}").repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
