"""Small tables with every awkward case, and the comparison with SQL twins."""

import os

import pyarrow as pa
import pyarrow.parquet as pq

SF = "/root/testdata/sf0.001"
GIVEN = "the quick brown fox jumps over a lazy dog while seven wizards mix potent jade elixirs in big boxes near quartz hills"


def sentence(seed, n):
    """``n`` words that depend on ``seed`` only."""
    out, x = [], seed * 7919 + 13
    for _ in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append(f"w{x >> 8}")
    return " ".join(out)


#: id, text: nulls, empty and white texts, ties, repeated rows, long texts, odd characters.
EDGE = [
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, sentence(1, 120)),
    (5, sentence(1, 120)),
    (5, sentence(1, 120)),
    (6, sentence(1, 118) + " other ending"),
    (None, sentence(2, 80)),
    (None, None),
    (7, sentence(3, 60) + "\n" + sentence(1, 50)),
    (8, "one two three"),
    (9, "One TWO three"),
    (10, "x " * 400),
    (11, "é́ ﬁ ＡＢ 日本語 İ 🎉 \x00\x1c\x85\xa0 <|endoftext|> ▁▁ <s>"),
    (12, sentence(4, 30_000)),
    (13, "a" * 20_000),
    (14, "line one here\nline one here\nother\n\nother\n"),
    (15, sentence(5, 40)),
    (16, sentence(5, 34)),
]


def edge_documents(spark):
    """The edge rows with columns whose names the operators use themselves."""
    rows = [(i, t, "xx" if (i or 0) % 2 else None, None, len(t) if t else None, "a", 1, True) for i, t in EDGE]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, spans string, key int, kept boolean"
    )


def rows_by(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def write_tables(folder, documents, labels=(), benchmark=(), pages=()):
    """A folder of tables like the given ones."""
    kinds = {
        "documents": (documents, [("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())]),
        "labels": (labels, [("doc_id", pa.int64()), ("quality", pa.int32()), ("toxic", pa.int32())]),
        "benchmark": (benchmark, [("item_id", pa.int64()), ("text", pa.string())]),
        "pages": (pages, [("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string())]),
    }
    for name, (rows, schema) in kinds.items():
        columns = list(zip(*rows)) if rows else [[] for _ in schema]
        arrays = [pa.array(list(c), t) for c, (_, t) in zip(columns, schema)]
        pq.write_table(pa.Table.from_arrays(arrays, names=[n for n, _ in schema]), os.path.join(folder, f"{name}.parquet"))
    return folder
