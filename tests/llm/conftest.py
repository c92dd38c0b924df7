import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

#: Names that operators use inside; a table may have them too.
CLASHING = ["ids", "part", "row", "key", "node", "score", "recipe", "n_words", "span_id", "near_id", "lost_id", "y", "wanted", "digests"]


def make_docs(spark, rows, extra=True):
    """documents from (doc_id, text), with further columns whose names clash."""
    schema = "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", `{c}` string" for c in CLASHING if extra)
    full = [(i, t, "en", "src", None if t is None else len(t), *["x"] * (len(CLASHING) if extra else 0)) for i, t in rows]
    return spark.createDataFrame(full, schema).repartition(3)


@pytest.fixture(scope="session")
def vocabulary():
    rng = random.Random(11)
    return ["".join(rng.choice("abcdefghiklmnoprstuvé中") for _ in range(rng.randint(1, 9))) for _ in range(4000)]


@pytest.fixture(scope="session")
def corpus(vocabulary):
    """(doc_id, text): nulls, empty and very long texts, copies, near copies, shared passages, repeated rows."""
    rng = random.Random(5)
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    rows = [(i, "\n".join(prose(rng.randint(4, 30)) for _ in range(rng.randint(1, 9)))) for i in range(60)]
    base, passage = prose(120), prose(40)
    for i in range(60, 90):  # near copies, some under the threshold
        words = base.split()
        for _ in range(rng.choice([0, 1, 2, 3, 5, 9])):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((i, " ".join(words)))
    rows += [(i, f"{prose(30)}\n{passage}\n{prose(25)}") for i in range(90, 104)]  # a passage that many share
    rows += [(104, base.upper()), (105, base.capitalize()), (106, rows[3][1]), (107, rows[3][1]), (108, None), (109, None), (110, ""), (111, " \n\t "), (112, "one two"), (113, "One two")]
    rows += [(114, "ha " * 3000), (115, "ha " * 3001), (116, "x" * 70_000), (117, prose(9000)), (118, "a\x0bb\x0cc\rd\x1ce\x85f g"), (None, rows[5][1]), (None, prose(30))]
    rows += [rows[7], rows[7], rows[60], (119, "\\ </s>[INST] <|im_end|> 'll don't  x's 99 €")]
    return rows
