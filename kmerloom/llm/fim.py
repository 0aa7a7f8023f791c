"""Fill-in-the-middle: texts cut at two seeded token ranks and put together in another order.

Method: a text is cut into chunks that overlap by one character. A token begins where white space follows another character, which
two adjacent characters tell, so each chunk counts its boundaries alone; prefix sums of the counts route the two cut ranks to the
chunks that own them, and only those are scanned again for the place.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from kmerloom.llm.common import arrow_map

#: Code points of a chunk. The chunks of a longer text are dealt to tasks.
CHUNK = 1 << 16
#: The marks of prefix, suffix and middle; texts that hold one stay plain.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def opens(points: np.ndarray, overlaps: bool) -> np.ndarray:
    """Which characters of a chunk begin a token: white space after another character, and the text's first. With ``overlaps`` the
    first character is the end of the chunk before and isn't the chunk's own."""
    white = (points == 32) | ((points >= 9) & (points <= 13))
    own = white[1:] & ~white[:-1]
    return own if overlaps else np.concatenate([np.ones(min(1, len(points)), bool), own])


def draws(doc_id: int | None, seed: str) -> list[int]:
    """The first four 8-digit groups of sha256("seed:id"); a null id counts as no digits."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[4 * i : 4 * i + 4], "big") for i in range(4)]


def ranks(doc_id: int | None, n: int, seed: str) -> tuple[int, int]:
    """Tokens before the first and before the second cut."""
    h1, h2, *_ = draws(doc_id, seed)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    return a, b


def form_of(doc_id: int | None, text: str, rate: int, suffix_first: int, seed: str) -> str:
    _, _, h3, h4 = draws(doc_id, seed)
    if not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= rate:
        return "plain"
    return "spm" if h4 % 100 < suffix_first else "psm"


def arranged(text: str, form: str, a: int, b: int) -> str:
    """The text cut before the code points a and b, in the order of ``form``."""
    if form == "plain":
        return text
    head, middle, tail = text[:a], text[a:b], text[b:]
    return f"{PREFIX}{head}{SUFFIX}{tail}{MIDDLE}{middle}" if form == "psm" else f"{SUFFIX}{tail}{PREFIX}{head}{MIDDLE}{middle}"


def restored(output: str, form: str) -> str:
    """The text that ``arranged`` was given. Texts with a mark stay plain, so the first mark found is the one put in."""
    if form == "plain":
        return output
    one, rest = output[len(PREFIX) :].split(SUFFIX if form == "psm" else PREFIX, 1)
    two, middle = rest.split(MIDDLE, 1)
    return one + middle + two if form == "psm" else two + middle + one


def _counted(batch: dict[str, list]) -> dict[str, list]:
    return {**{c: batch[c] for c in ("doc_id", "key", "chunk")}, "n": [int(opens(code_points(p), c > 0).sum()) for p, c in zip(batch["piece"], batch["chunk"])]}


def _placed(batch: dict[str, list], chunk: int) -> dict[str, list]:
    """Where the wanted ranks of a chunk lie, in code points of the text."""
    out: dict[str, list] = {"doc_id": [], "key": [], "rank": [], "at": []}
    for doc_id, key, c, piece, before, wanted in zip(*(batch[x] for x in ("doc_id", "key", "chunk", "piece", "before", "wanted"))):
        places = np.flatnonzero(opens(code_points(piece), c > 0))
        for rank in wanted:
            for name, value in (("doc_id", doc_id), ("key", key), ("rank", rank), ("at", c * chunk + int(places[rank - before]))):
                out[name].append(value)
    return out


def _found(long: DataFrame, seed: str, chunk: int) -> DataFrame:
    """(doc_id, key, n, places): number of tokens, and the code points of both cuts by rank (rank n has none), of texts of several chunks."""

    def pieces(batch: dict[str, list]) -> dict[str, list]:
        rows = [(i, k, c // chunk, t[max(0, c - 1) : c + chunk]) for i, k, t in zip(batch["doc_id"], batch["key"], batch["text"]) for c in range(0, len(t), chunk)]
        return dict(zip(("doc_id", "key", "chunk", "piece"), map(list, zip(*rows)))) if rows else {c: [] for c in ("doc_id", "key", "chunk", "piece")}

    one = "doc_id long, key string, chunk int"
    dealt = arrow_map(long, pieces, f"{one}, piece string").repartition("doc_id", "key", "chunk")
    counts = arrow_map(dealt, _counted, f"{one}, n long")
    text = Window.partitionBy("doc_id", "key")
    # rows of one id and text are one text here
    sums = counts.groupBy("doc_id", "key", "chunk").agg(F.first("n").alias("n")).withColumns({"before": F.coalesce(F.sum("n").over(text.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "all": F.sum("n").over(text)})
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    cuts = F.array(*(F.pmod(F.conv(F.substring(digits, 1 + 8 * i, 8), 16, 10).cast("long"), F.col("all") + 1) for i in range(2)))
    routed = sums.withColumn("wanted", F.array_distinct(F.filter(cuts, lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("n")))))
    owners = routed.filter(F.size("wanted") > 0).select("doc_id", "key", "chunk", "before", "wanted")
    rescanned = dealt.alias("p").join(owners.alias("o"), F.col("p.doc_id").eqNullSafe(F.col("o.doc_id")) & (F.col("p.key") == F.col("o.key")) & (F.col("p.chunk") == F.col("o.chunk")))
    places = arrow_map(rescanned.select("p.doc_id", "p.key", "p.chunk", "piece", "before", "wanted"), lambda b: _placed(b, chunk), "doc_id long, key string, rank long, at long")
    listed = places.groupBy("doc_id", "key").agg(F.collect_set(F.struct("rank", "at")).alias("places"))  # two at most
    total = sums.groupBy("doc_id", "key").agg(F.first("all").alias("n"))
    same = total["doc_id"].eqNullSafe(listed["doc_id"]) & (total["key"] == listed["key"])
    return total.join(listed, same, "left").select(total["doc_id"], total["key"], "n", "places")


def fill_in_middle(docs: DataFrame, rate: int = 50, suffix_first: int = 80, seed: str = "42", chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row: ``rate`` percent of the texts are cut at two token ranks, of these
    ``suffix_first`` percent in the form spm, the rest psm.

    n counts the tokens `white space* other+` (white space at the end is one too). Texts of one chunk are scanned in their row. The chunks of longer ones are
    dealt to tasks, counted there, and the two chunks that own a cut scanned again; a long text is read by
    the task of its row only to be put together. Null texts count as empty; empty texts and those with a mark stay plain; null ids draw as an id without
    digits; repeated ids keep their rows; other columns are ignored; an empty table gives an empty one.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    several = F.length("text") > chunk
    long = rows.filter(several).withColumn("key", F.sha2("text", 256))
    none = F.expr("cast(null as array<struct<rank:bigint,at:bigint>>)")
    found = _found(long, seed, chunk)
    same = long["doc_id"].eqNullSafe(found["doc_id"]) & (long["key"] == found["key"])
    ready = rows.filter(~several).select("doc_id", "text", F.lit(None).cast("long").alias("n"), none.alias("places")).unionByName(long.join(found, same).select(long["doc_id"], "text", "n", "places"))

    def finish(batch: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {c: [] for c in ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output")}
        for doc_id, text, n, places in zip(*(batch[c] for c in ("doc_id", "text", "n", "places"))):
            if n is None:  # one chunk, which owns both ranks
                begins = np.flatnonzero(opens(code_points(text), False))
                n = len(begins)
                at = {r: int(begins[r]) for r in ranks(doc_id, n, seed) if r < n}
            else:
                at = {p["rank"]: p["at"] for p in places or ()}
            at[n] = len(text)
            a, b = (at[r] for r in ranks(doc_id, n, seed))
            form = form_of(doc_id, text, rate, suffix_first, seed)
            cut = form != "plain"
            for c, value in zip(out, (doc_id, n, form, a if cut else None, b - a if cut else None, arranged(text, form, a, b))):
                out[c].append(value)
        return out

    return arrow_map(ready, finish, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(done: DataFrame) -> DataFrame:
    """``done(output, form, ...)`` with ``restored``: the texts before the transformation."""
    kept = done.select(*(c for c in done.columns if c != "restored"))

    def rows(batch: dict[str, list]) -> dict[str, list]:
        return {**batch, "restored": list(map(restored, batch["output"], batch["form"]))}

    return arrow_map(kept, rows, StructType([*kept.schema.fields, StructField("restored", StringType())]))
