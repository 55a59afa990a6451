"""Visually identical text -> one consistent form.

Texts are cut into stable runs (characters that the mapping leaves alone) and short unstable pieces; the
pieces are exploded to positioned code points, mapped by broadcast joins (decomposition, look-alikes,
blanks, invisible characters), combining marks are ordered by class within their starter, each starter
with its marks is recomposed by a third broadcast join, and the strings are rebuilt.  All three tables
follow from Unicode's data and are of fixed size (a few thousand rows).  The texts are partitioned by key
once; every later grouping is by that key or finer and needs no further exchange.
"""

from __future__ import annotations

import itertools
import unicodedata

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Letters of other scripts that look like Latin ones, as "letters=Latin letters", by script.
LOOKALIKES = [
    # Cyrillic
    "аеорсухіјѕԁԛԝһӏѵ=aeopcyxijsdqwhlv",
    "АВЕКМНОРСТХІЈЅУԚԜҺѴӀ=ABEKMHOPCTXIJSYQWHVI",
    # Greek
    "νοριαϲϳυ=vopiacju",
    "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ=ABEZHIKMNOPTYXCJ",
    # Armenian
    "օսհցզոք=ouhgqnp",
    "ՕՍՏԼ=OUSL",
    # Cherokee
    "ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᏒᏚᎢᏙᎳᏃᎥᎡᏔᎽ=ABCDEGHJKLMPRSTVWZiRWY",
    # Lisu
    "ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ=BPDTGKJCZFMNLSRVHWXYAEIOU",
    # Coptic
    "ⲟⲣⲥⲭⲟ=opcxo",
    "ⲀⲂⲈⲎⲒⲔⲘⲚⲞⲢⲤⲦⲨⲬ=ABEHIKMNOPCTYX",
    # phonetic letters, small capitals of the same shape, dashes and apostrophes
    "ɑɡℓᴄᴏᴠᴡᴢ=aglcovwz",
    "‐‑⁃−‒ʼ‛ʹ=-----'''",
]
#: Compatibility mappings that keep a character's look.
SAME_LOOK = ("<wide>", "<narrow>", "<font>", "<noBreak>", "<compat>", "<initial>", "<medial>", "<final>", "<isolated>")
#: Where Unicode has characters that may be mapped: the first two planes, the compatibility ideographs, tags and variation selectors.
_RANGES = (range(0x80, 0x20000), range(0x2F800, 0x2FA20), range(0xE0000, 0xE1000))
#: Characters the mapping leaves alone unless a mark follows: ASCII, composed Latin letters, common punctuation.
_STABLE = r" -~¡-§©-¬®¶·»¿-ıĴ-ľŁ-ňŊ-žƀ-ƣƤ-ǀǍ-ǰǴ-ȳḀ-ẙẠ-ỹ–-—“-„†•‰‹›€™"


def _lookalike_pairs() -> dict[str, str]:
    pairs: dict[str, str] = {}
    for line in LOOKALIKES:
        a, b = line.split("=", 1)
        pairs |= dict(zip(a, b, strict=True))
    return pairs


def targets_of(ch: str, pairs: dict[str, str] | None = None) -> str:
    """What one character becomes, fully decomposed; '' for what can't be seen."""
    pairs = _lookalike_pairs() if pairs is None else pairs
    cat = unicodedata.category(ch)
    if ch in "\t\n\r\x0b\x0c\x85" or cat in ("Zs", "Zl", "Zp"):
        return " "
    if cat == "Cf" or 0xFE00 <= ord(ch) <= 0xFE0F or 0xE0100 <= ord(ch) <= 0xE01EF or ch in "͏ᅟᅠㅤ":
        return ""
    if ch in pairs:
        return pairs[ch]
    form = unicodedata.decomposition(ch)
    if not form:
        return ch
    parts = form.split()
    if parts[0].startswith("<"):
        if parts[0] not in SAME_LOOK:
            return ch
        parts = parts[1:]
    out = "".join(targets_of(chr(int(x, 16)), pairs) for x in parts)
    # A spacing accent decomposes to a blank with a mark; it stays as it is.
    return ch if out.startswith(" ") and len(out) > 1 else out


def _tables(spark: SparkSession):
    pairs = _lookalike_pairs()
    mapping, marks, composed = [], [], []
    for cp in itertools.chain(*_RANGES):
        if 0xAC00 <= cp <= 0xD7A3 or 0xD800 <= cp <= 0xDFFF or 0x3400 <= cp <= 0x9FFF or 0x17000 <= cp <= 0x18CFF:
            continue
        ch = chr(cp)
        if (t := targets_of(ch, pairs)) != ch:
            mapping.append((ch, list(t)))
            if unicodedata.decomposition(ch) and not unicodedata.decomposition(ch).startswith("<") and len(t) > 1:
                if all(unicodedata.combining(c) for c in t[1:]) and not unicodedata.combining(t[0]):
                    composed.append((t, ch))
        if c := unicodedata.combining(ch):
            marks.append((ch, c))
    mapping += [(c, [" "]) for c in "\t\n\r\x0b\x0c"] + [(chr(c), []) for c in (*range(0, 9), *range(14, 32), 127)]
    best: dict[str, str] = {}
    for seq, ch in composed:
        best.setdefault(seq, ch)
    df = lambda rows, schema: F.broadcast(spark.createDataFrame(rows, schema))
    return df(mapping, "unit string, targets array<string>"), df(marks, "ch string, ccc int"), df(sorted(best.items()), "seq string, whole string")


def one_form(df: DataFrame, key: str, text: str, out: str = "one_form") -> DataFrame:
    """(key, out): each text in its one consistent form.

    A null text gives null, an empty one ''; keys must be unique (repeated rows of a key with the same text
    should be made distinct before).  Blanks of any kind become one plain blank each, full-width forms and
    ligatures their plain letters, look-alike letters Latin ones; invisible characters go; letter case,
    accents, digits and words stay.  Other columns are dropped.
    """
    mapping, marks, whole = _tables(df.sparkSession)
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)
    base = df.select(F.col(key).alias("k"), F.translate(F.col(text).cast("string"), "\t\n\r\x0b\x0c", "     ").alias("t")).repartition(n, "k")
    # An unstable run takes the character before it along, which its marks may belong to.
    pieces = F.regexp_extract_all("t", F.lit(f"(?s)[{_STABLE}]?[^{_STABLE}]+|[{_STABLE}]++\\z|[{_STABLE}]+(?=[{_STABLE}][^{_STABLE}])"), F.lit(0))
    rows = base.select("k", F.col("t").isNull().alias("null_text"), F.posexplode_outer(F.when(F.length("t") > 0, pieces)).alias("seg", "piece"))
    units = F.when(F.col("piece").rlike(f"(?s)^.?[^{_STABLE}]"), F.split("piece", "")).otherwise(F.array("piece"))
    rows = rows.select("k", "null_text", "seg", F.posexplode_outer(units).alias("pos", "unit")).join(mapping, "unit", "left")
    rows = rows.select("k", "null_text", "seg", "pos", F.posexplode_outer(F.coalesce("targets", F.array("unit"))).alias("sub", "ch"))
    rows = rows.join(marks, "ch", "left").withColumn("ccc", F.coalesce("ccc", F.lit(0)))
    order = Window.partitionBy("k").orderBy("seg", "pos", "sub")
    rows = rows.withColumn("starter", F.sum((F.col("ch").isNotNull() & (F.col("ccc") == 0)).cast("long")).over(order))
    grouped = rows.groupBy("k", "starter").agg(
        F.first("null_text").alias("null_text"),
        F.array_sort(F.collect_list(F.when(F.col("ch").isNotNull(), F.struct("ccc", "seg", "pos", "sub", "ch")))).alias("cs"),
    )
    grouped = grouped.withColumn("seq", F.array_join(F.transform("cs", lambda c: c["ch"]), "")).join(whole, "seq", "left")
    rebuilt = grouped.groupBy("k").agg(
        F.first("null_text").alias("null_text"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("starter", F.coalesce("whole", "seq").alias("s")))), lambda x: x["s"]), "").alias("s"),
    )
    return rebuilt.select(F.col("k").alias(key), F.when(~F.col("null_text"), F.col("s")).alias(out))


def matches_by_look(quotes: DataFrame, texts: DataFrame) -> DataFrame:
    """p6: (candidate_id) of quotes that stand in their CV's text only by appearance.

    quotes: candidate_id, cv_id, anchor_quote; texts: cv_id, text.  Null and empty quotes, null keys and
    CVs without a text give no row; redelivered candidates count once.
    """
    q = quotes.where("candidate_id is not null and cv_id is not null and anchor_quote <> ''").groupBy("candidate_id").agg(F.min(F.struct("cv_id", "anchor_quote")).alias("q"))
    q = q.select("candidate_id", F.col("q.cv_id").alias("q_cv"), F.col("q.anchor_quote").alias("anchor_quote"))
    t = texts.where("cv_id is not null and text is not null").select("cv_id", "text")
    qn = q.join(one_form(q, "candidate_id", "anchor_quote", "quote_form"), "candidate_id")
    tn = t.join(one_form(t, "cv_id", "text", "text_form"), "cv_id")
    joined = qn.join(tn, F.col("q_cv") == F.col("cv_id"))
    # A quote of invisible characters only is no quote.
    hit = ~F.col("text").contains(F.col("anchor_quote")) & F.col("text_form").contains(F.col("quote_form")) & (F.trim("quote_form") != "")
    return joined.where(hit).select("candidate_id").distinct()
