"""Quotes of any length against a search of every chunk."""

import re

from proofline.operators import quotes


def test_short_quotes(spark):
    plain = lambda t: re.sub(r"\s+", " ", t).strip(" ")
    chunks = [(1, "The pump  starts\nat 40 °C and stops."), (2, "A pumping station at 40 °C"), (3, "é"), (4, None), (5, ""), (6, "one two three four five six seven")]
    asked = ["pump", "pump starts", "p", "°C", "é", "mp st", "at 40 °C", "at 40", "starts at 40 °C", "e two three fo", "two three four five six", "ne two three four five six s", "pumps", "", "   ", None, "ump starts at 4", "pumping station", "x y", "five six"]
    found = quotes.occurrences(spark.createDataFrame(list(enumerate(asked)), "quote_id long, quote string"), spark.createDataFrame(chunks, "chunk_id long, text string"))
    want = [(i, c) for i, q in enumerate(asked) for c, t in chunks if q and plain(q) and t and plain(q) in plain(t)]
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert {r.quote_id for r in quotes.only_home(found).collect()} == {i for i, _ in want if sum(j == i for j, _ in want) == 1}
