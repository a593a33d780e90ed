import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

LONG = " ".join(f"w{i % 4999} x{i % 61}" for i in range(30_000))
PASSAGE = "the quick brown fox jumps over the lazy dog and runs away from all of them today"
CLASH = "range string, hits string, score double, size string, target string, n_words string, __row string, host string, fp string"

#: Nulls in every column, empty and very long texts, ties, repeated rows.
DOCUMENTS = [
    (1, PASSAGE + " one", "en", "a"),
    (2, "Intro. " + PASSAGE.upper() + "! two", "en", "a"),
    (3, "three\t" + PASSAGE.replace(" ", "\n"), None, "b"),
    (3, "three\t" + PASSAGE.replace(" ", "\n"), None, "b"),
    (3, PASSAGE + " same id, other text", "en", None),
    (None, PASSAGE, "en", "a"),
    (None, None, None, None),
    (7, None, "fr", "c"),
    (8, "", "fr", "c"),
    (9, " \t\n\x0b\x0c\r ", "fr", "c"),
    (10, "a", "fr", "é"),
    (11, "a b", "fr", "é"),
    (12, "ÀB c d   é \x00 <|endoftext|>  \n  end ", "de", "c"),
    (13, LONG, "en", "a"),
    (14, LONG + " tail", "en", "a"),
    (15, "123 456 !!! ½", "en", "d"),
    (-5, "negative id " + PASSAGE, "en", "d"),
    (1 << 62, "large id", "en", "d"),
]
BENCHMARK = [(100, PASSAGE), (20, PASSAGE), (3, "large ID!"), (4, None), (5, " .,"), (None, "negative id"), (6, LONG[:200])]
HTML = "<html>" + "é" * 120 + "</html>"
PAGES = [
    (1, "http://Example.ORG/es/1?x#y", HTML), (2, "https://a.example.org/en/12", HTML), (2, "https://a.example.org/en/12", HTML),
    (0, "http://b.com/de/", HTML), (4, None, None), (5, "no scheme", ""), (6, "http://x.org", "short"), (7, "http://x.org?q", "short"),
    (8, "ftp://c.com/fr/\r\nX: y", "<p>" + LONG), (9, "://net/", "a" * 99), (10, "http://org/", "a" * 99), (11, "http://notorg.orgs/a", "b" * 100),
    (None, "http://example.com/fr/a", HTML), (None, "http://example.com/fr", None), (12, "http://u@com:80/de/", "b" * 100),
]
NAN, INF = float("nan"), float("inf")
#: Ties, repeated rows, equal vectors, other lengths, odd components and ids.
EMBEDDINGS = [
    (0, [0.5, 0.25], 1), (0, [0.5, 0.25], 1), (1, [0.5, 0.25], 2), (2, [0.5, 0.25], 1), (3, [0.4, 0.2], 1), (4, [0.4, 0.3], 2), (7, [0.45, 0.25], 9),
    (14, [0.45, 0.25], 0), (5, [-0.5, -0.25], 2), (6, [0.0, 0.0], 1), (8, [0.0, 0.0], 2), (100, [0.0, 0.0], 1), (200, [-0.3, 0.9], 3), (300, [1.0], 1),
    (301, [1.0], 1), (302, [0.9], 2), (400, [], 1), (401, [], 1), (402, [], 4), (500, None, 1), (501, [0.1, None], 1), (600, [NAN, 0.1], 1),
    (601, [0.2, INF], 2), (700, [0.5, 0.5], None), (None, [0.5, 0.25], 1), (None, [0.48, 0.22], 4), (-100, [0.5, 0.24], 3), (9, [0.5, 0.23], 3), (10, [0.3, 0.3], 3),
    *[(20 + i, [0.45, 0.26], 6) for i in range(9)], *[(1000 + i, [0.44, 0.2], 1) for i in range(9)], (1 << 40, [300.0, -7.5], 5), (800, [200.0, -2.0], 5), (801, [190.0, 3.0], 6),
]
LABELS = [(1, 1, 0), (2, 1, 0), (13, 0, 0), (14, 0, 1), (None, 1, 0), (15, None, 0), (99, 0, 0), (1, 1, 0)]


def write_tables(spark, folder, empty=False):
    def save(name, rows, schema, extra):
        names = [c.split()[0] for c in extra.split(", ")] if extra else []
        rows = [] if empty else [tuple(r) + (None,) * len(names) for r in rows]
        spark.createDataFrame(rows, f"{schema}, {extra}" if extra else schema).repartition(3).write.parquet(f"{folder}/{name}.parquet")

    save("documents", [(*r, None if r[1] is None else len(r[1])) for r in DOCUMENTS], "doc_id long, text string, lang string, source string, n_chars long", CLASH)
    save("benchmark", BENCHMARK, "item_id long, text string", "n_words string")
    save("pages", PAGES, "page_id long, url string, html string", "host string, verdict string, size string, digest string, refers_to string")
    save("embeddings", EMBEDDINGS, "vec_id long, embedding array<float>, label int", "vec string, size string, anchor string, score string, qid string, ids string")
    save("labels", LABELS, "doc_id long, quality int, toxic int", "y string, text string")
    return folder


@pytest.fixture(scope="session")
def edge(spark, tmp_path_factory):
    return write_tables(spark, str(tmp_path_factory.mktemp("edge")))


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    return write_tables(spark, str(tmp_path_factory.mktemp("empty")), empty=True)
