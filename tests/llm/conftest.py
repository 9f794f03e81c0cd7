import pytest

#: Texts with everything that is awkward: nulls, blanks, ties, copies, other
#: scripts, one long word, one long text.
TEXTS = [
    (1, "the cat sat on the mat and the dog lay on the rug by the door of the old house at the end of the lane"),
    (2, "the cat  sat on\tthe mat and the dog lay on the rug by the door of the old house at the end of the lane"),
    (3, None), (4, ""), (5, " \n\t "), (6, "one"), (7, "One"), (8, "a b c"),
    (9, "x" * 3000), (10, "été déjà 漢字 😀 naïve " * 30),
    (11, "\n".join(f"line {i % 7} of text number {i % 3}" for i in range(200))),
    (12, "the cat sat on the mat and the dog lay on the rug by the door of the old barn at the end of the lane"),
    (13, " ".join(f"w{i * i % 97}" for i in range(6000))),
    (13, " ".join(f"w{i * i % 97}" for i in range(6000))),
    (14, "### $$$ *** !!! &&& %%% " * 40), (None, "a row without an id " * 9), (None, None),
]


@pytest.fixture(scope="session")
def awkward(spark):
    """Awkward rows, with columns named like those the operators make."""
    rows = [(i, t, "en", None if n % 5 == 0 else f"s{n % 3}", 7, "x", 1, b"x") for n, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, block int, "
                                       "size string, row int, digest binary").repartition(4)


@pytest.fixture(scope="session")
def none(awkward):
    return awkward.where("false")
