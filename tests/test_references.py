"""Character references against the standard library."""

from html import unescape
from html.entities import html5

from pyspark.sql import functions as F

from postledger.functions.flags import decode_references


def test_every_reference_is_decoded(spark):
    texts = [f"a &{name} b&{name}x" for name in html5]
    texts += [f"&#{n};&#x{n:X}" for n in [*range(0, 300), 0x2019, 0xD800, 0xFDD0, 0xFFFE, 0x1F600, 0x10FFFF, 0x110000, 10**9]]
    texts += ["", "&", "&&amp;lt;", "&#;", "&#x;", "&#x0000041;", "&nope; &notit; &amp", "x & y", "&#99999999999999999999;"]
    rows = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string").select("t", decode_references(F.col("t")).alias("d")).collect()
    wrong = [(r.t, r.d, unescape(r.t)) for r in rows if r.t is not None and r.d != unescape(r.t)]
    assert wrong == [] and [r.d for r in rows if r.t is None] == [None]
