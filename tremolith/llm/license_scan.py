"""License scans by diagonal voting, in DataFrame expressions alone.

Every rolling run of three words of a text is hashed and joined to the
positions at which the license templates have that run (a fixed list of less
than a thousand rows, so its broadcast has a proven bound; the run itself is
compared too, so a colliding hash never votes).  A match at word d of the text
and word t of the template votes for the diagonal d - t.  Votes are counted per
text, template and diagonal.

Base phrases and short notices are templates that count only whole: all their
runs on one diagonal.  Long passages need MIN_COVERAGE of their runs, over a
chain of diagonals: an insertion or a deletion, however long, starts a new
diagonal, which joins the chain if its words come later in both the text and the
template.  A chain begins at most SPREAD times the template's words before its
last diagonal.  Of all chains that end at a diagonal the one with the most votes
is taken; verified chains that overlap are one span.

Licenses share passages.  Of long passages of different labels whose spans
overlap, only the one with the best coverage stays (then the one with more runs
found), so that the words that tell two licenses apart decide.

A notice that names a version gives the label with the version beside the
general one ("gpl,gpl-3").

Defined results: a null text counts as empty, with n_words and n_base 0, null
positions, empty labels and score 0.  score is the best coverage found (1 for a
base phrase or a short notice).  Rows that repeat both doc_id and text give a row
each; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import table

K = 3
SPREAD = 3
MIN_COVERAGE = 0.6

# The base phrases and their labels.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Characteristic passages of well-known public licenses.
TEMPLATES = {
    "mit": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    ),
    "apache-2": (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    ),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "may be used to endorse or promote products derived from this software without specific prior written permission",
    ),
    "gpl": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
        "you should have received a copy of the gnu general public license along with this program",
    ),
    "lgpl": (
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
        "you should have received a copy of the gnu lesser general public license along with this library",
    ),
    "agpl": ("this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation",),
    "mpl-2": (
        "this source code form is subject to the terms of the mozilla public license v 2 0",
        "if a copy of the mpl was not distributed with this file you can obtain one at",
    ),
    "isc": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",),
    "cc-by": ("this work is licensed under a creative commons attribution 4 0 international license",),
    "cc-by-sa": ("this work is licensed under a creative commons attribution sharealike 4 0 international license",),
    "cc-by-nc": ("this work is licensed under a creative commons attribution noncommercial 4 0 international license",),
    "cc-by-nd": ("this work is licensed under a creative commons attribution noderivatives 4 0 international license",),
    "cc0": ("to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",),
    "unlicense": (
        "this is free and unencumbered software released into the public domain",
        "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary",
    ),
    "boost": ("permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",),
    "zlib": ("this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software",),
    "all-rights-reserved": ("all rights reserved no part of this publication may be reproduced",),
}
# Names by which short notices give a license; "license" is also
# looked for as "licence".
NOTICES = {
    "mit": ("the mit license", "mit license mit", "licensed under mit", "license mit license", "spdx license identifier mit"),
    "apache-2": ("apache license 2 0", "apache license v2", "apache license v 2", "apache 2 0 license", "apache software license 2 0", "apache software license version 2", "license identifier apache 2 0"),
    "bsd": (
        "the bsd license", "under bsd license", "bsd 2 clause", "bsd 3 clause", "bsd 4 clause", "2 clause bsd", "3 clause bsd", "4 clause bsd", "two clause bsd", "three clause bsd",
        "new bsd license", "modified bsd license", "simplified bsd license", "revised bsd license", "bsd style license",
    ),
    "gpl": ("gnu general public license", "gnu public license", "the gnu gpl", "under the gpl", "license identifier gpl"),
    "gpl-2": ("gnu general public license version 2", "gnu general public license v2", "gnu general public license v 2", "gnu gpl version 2", "gnu gpl v2", "gpl version 2", "gpl 2 0", "under the gplv2"),
    "gpl-3": ("gnu general public license version 3", "gnu general public license v3", "gnu general public license v 3", "gnu gpl version 3", "gnu gpl v3", "gpl version 3", "gpl 3 0", "under the gplv3"),
    "lgpl": ("gnu lesser general public license", "gnu library general public license", "the gnu lgpl", "under the lgpl", "license identifier lgpl"),
    "lgpl-2": ("gnu library general public license version 2", "gnu lesser general public license version 2", "gnu lesser general public license v2", "gnu lgpl v2", "lgpl version 2", "lgpl 2 1", "lgpl 2 0", "under the lgplv2"),
    "lgpl-3": ("gnu lesser general public license version 3", "gnu lesser general public license v3", "gnu lesser general public license v 3", "gnu lgpl v3", "lgpl version 3", "lgpl 3 0", "under the lgplv3"),
    "agpl": ("gnu affero general public license", "affero general public license", "the gnu agpl", "under the agpl", "license identifier agpl"),
    "agpl-3": ("affero general public license version 3", "affero general public license v3", "agpl version 3", "agpl 3 0", "under the agplv3"),
    "mpl": ("mozilla public license",),
    "mpl-2": ("mozilla public license version 2", "mozilla public license v 2", "mozilla public license v2", "mozilla public license 2 0", "mpl 2 0"),
    "epl": ("eclipse public license",),
    "eupl": ("european union public license",),
    "bsl-1": ("boost software license",),
    "zlib": ("the zlib license", "zlib libpng license"),
    "isc": ("the isc license", "under isc license", "spdx license identifier isc"),
    "cc-by": ("creative commons attribution license", "creative commons attribution international", *(f"{n} {v} 0" for n in ("creative commons attribution", "cc by") for v in "234"), "cc by 2 5"),
    "cc-by-sa": ("cc by sa", "creative commons attribution sharealike", "creative commons attribution share alike"),
    "cc-by-nd": ("cc by nd", "creative commons attribution noderivatives", "creative commons attribution noderivs", "creative commons attribution no derivatives"),
    "cc-by-nc": ("creative commons attribution noncommercial", "creative commons attribution non commercial"),
    "cc-by-nc-sa": ("cc by nc sa", "creative commons attribution noncommercial sharealike", "creative commons attribution noncommercial share alike", "creative commons attribution non commercial share alike"),
    "cc-by-nc-nd": ("cc by nc nd", "creative commons attribution noncommercial noderivatives", "creative commons attribution noncommercial noderivs", "creative commons attribution non commercial no derivatives"),
    "cc0": ("cc0 1 0", "creative commons zero", "creative commons cc0", "cc0 public domain dedication", "under cc0 license"),
    "unlicense": ("under the unlicense", "license identifier unlicense"),
    "public-domain": ("into the public domain", "in the public domain", "dedicated to the public domain"),
    "all-rights-reserved": ("all rights reserved", "all rights are reserved"),
}
_UPPER, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def templates() -> list[tuple[str, str, bool, bool]]:
    """phrase, label, base, whole (counts only whole) of every template."""
    short = sorted({(p.replace("license", word), label) for label, phrases in NOTICES.items() for p in phrases for word in ("license", "licence")})
    return [(p, label, True, True) for p, label in BASE.items()] + [(p, label, False, True) for p, label in short] + [(p, label, False, False) for label, passages in TEMPLATES.items() for p in passages]


def template_runs(spark: SparkSession) -> DataFrame:
    """template, label, base, whole, runs (of the template), t, run: one row a run."""
    rows = []
    for number, (phrase, label, base, whole) in enumerate(templates()):
        words = phrase.split()
        n = len(words) - K + 1
        rows += [(number, label, base, whole, n, t, " ".join(words[t : t + K])) for t in range(n)]
    return spark.createDataFrame(rows, "template int, label string, base boolean, whole boolean, runs int, t int, run string")


def words_of(text) -> F.Column:
    """The words of a lower-cased text, without the empty ends of split()."""
    raw = F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOW), _GAPS)
    head = F.when(F.element_at(raw, 1) == "", 1).otherwise(0)
    tail = F.when((F.size(raw) > 1) & (F.element_at(raw, -1) == ""), 1).otherwise(0)
    return F.slice(raw, head + 1, F.size(raw) - head - tail)


def best_chain(near, first, t, runs) -> F.Column:
    """votes and begin of the best chain that ends at the diagonal whose first
    match is (first, t).  ``near`` has the diagonals of its surroundings, in the
    order of their first words.  Runs that two diagonals share count once."""
    kind = "array<struct<first:int,t:int,last:int,end:int,votes:double,begin:int>>"

    def gain(c, x):
        return x["votes"] - F.greatest(F.lit(0), c["last"] - x["first"] + 1, c["end"] - x["t"] + 1)

    def extend(chains, x):
        before = F.filter(chains, lambda c: (c["first"] < x["first"]) & (c["t"] < x["t"]) & (c["last"] < x["last"]) & (c["end"] < x["end"]) & (gain(c, x) > 0) & (x["first"] - c["begin"] <= SPREAD * (runs + (K - 1))))
        longer = F.transform(before, lambda c: F.struct((c["votes"] + gain(c, x)).alias("votes"), c["begin"].alias("begin")))
        best = F.array_max(F.concat(F.array(F.struct(x["votes"].alias("votes"), x["first"].alias("begin"))), longer))
        return F.concat(chains, F.array(F.struct(x["first"].alias("first"), x["t"].alias("t"), x["last"].alias("last"), x["end"].alias("end"), best["votes"].alias("votes"), best["begin"].alias("begin"))))

    chains = F.aggregate(near, F.array().cast(kind), extend)
    own = F.element_at(F.filter(chains, lambda c: (c["first"] == first) & (c["t"] == t)), 1)
    return F.struct(own["votes"].alias("votes"), own["begin"].alias("begin"))


def spans(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per text and verified span: ``id, th, template, label, base, first, last,
    coverage``; and per text one row with a null template that carries
    ``copies`` (rows alike) and ``n_words``."""
    listed = template_runs(spark).withColumn("h", F.xxhash64("run"))
    words = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), words_of(F.col(text_col)).alias("w"))
    # Run -1 stands for the text itself, so that texts without any match stay.
    runs = words.select(
        "id", "th", F.size("w").alias("n"),
        F.posexplode(F.concat(
            F.array(F.lit(None).cast("string")),
            F.when(F.size("w") >= K, F.transform(F.sequence(F.lit(1), F.size("w") - (K - 1)), lambda i: F.concat_ws(" ", *[F.element_at("w", i + j) for j in range(K)]))).otherwise(F.array().cast("array<string>")),
        )).alias("d", "r"),
    )
    runs = runs.withColumn("d", F.col("d") - 1).withColumn("rh", F.when(F.col("r").isNotNull(), F.xxhash64("r")))
    hits = runs.join(F.broadcast(listed), (F.col("rh") == F.col("h")) & (F.col("r") == F.col("run")), "left").filter("d < 0 OR template IS NOT NULL")
    votes = hits.groupBy("id", "th", "template", (F.col("d") - F.col("t")).alias("diagonal")).agg(
        F.count(F.lit(1)).alias("votes"), F.max("n").alias("n_words"), F.first("label").alias("label"), F.first("base").alias("base"),
        F.first("whole").alias("whole"), F.first("runs").alias("runs"), F.min("d").alias("first"), F.max("d").alias("last"),
    )
    text = Window.partitionBy("id", "th")
    votes = votes.withColumn("copies", F.max(F.when(F.col("template").isNull(), F.col("votes"))).over(text))
    votes = votes.withColumn("votes", F.col("votes") / F.col("copies")).withColumn("t", F.col("first") - F.col("diagonal"))
    reach = SPREAD * max(len(p.split()) for passages in TEMPLATES.values() for p in passages)
    around = Window.partitionBy("id", "th", "template").orderBy("first").rangeBetween(-reach, 0)
    match = F.struct("first", "t", "last", (F.col("last") - F.col("diagonal")).alias("end"), "votes")
    votes = votes.withColumn("near", F.collect_list(F.when(~F.col("whole"), match)).over(around))
    # A single diagonal is its own chain; too few votes around need none.
    alone = F.struct(F.col("votes"), F.col("first").alias("begin"))
    enough = (F.size("near") > 1) & (F.aggregate("near", F.lit(0.0), lambda n, x: n + x["votes"]) >= MIN_COVERAGE * F.col("runs"))
    votes = votes.withColumn("chain", F.when(enough, best_chain(F.col("near"), F.col("first"), F.col("t"), F.col("runs"))).otherwise(alone)).drop("near")
    votes = votes.withColumn("coverage", F.least(F.col("chain.votes") / F.col("runs"), F.lit(1.0))).withColumn("begin", F.col("chain.begin"))
    # least() passes over nulls, and the row of the text itself has no runs.
    votes = votes.withColumn("coverage", F.when(F.col("template").isNotNull(), F.col("coverage")))
    votes = votes.filter(F.col("template").isNull() | (F.col("coverage") >= F.when(F.col("whole"), 1.0).otherwise(MIN_COVERAGE)))
    along = Window.partitionBy("id", "th", "template").orderBy("begin", "last")
    apart = F.col("begin") > F.max("last").over(along.rowsBetween(Window.unboundedPreceding, -1))
    votes = votes.withColumn("span", F.sum(F.when(apart | F.col("whole"), 1).otherwise(0)).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    found = votes.groupBy("id", "th", "template", "span").agg(
        F.first("label").alias("label"), F.first("base").alias("base"), F.first("whole").alias("whole"), F.min("begin").alias("first"), (F.max("last") + (K - 1)).alias("last"),
        F.max("coverage").alias("coverage"), (F.max("coverage") * F.first("runs")).alias("found"), F.max("copies").alias("copies"), F.max("n_words").alias("n_words"),
    )
    # Of overlapping long passages of different labels the best stays.
    near = Window.partitionBy("id", "th").orderBy("first").rangeBetween(-2 * reach, 2 * reach)
    passage = F.struct("label", "first", "last", "coverage", "found")
    found = found.withColumn("others", F.collect_list(F.when(F.col("template").isNotNull() & ~F.col("whole"), passage)).over(near))

    def beats(o) -> F.Column:
        better = (o["coverage"] > F.col("coverage")) | ((o["coverage"] == F.col("coverage")) & (o["found"] > F.col("found")))
        return (o["label"] != F.col("label")) & (o["first"] <= F.col("last")) & (o["last"] >= F.col("first")) & better

    beaten = F.coalesce(~F.col("whole"), F.lit(False)) & F.exists("others", beats)
    return found.filter(~beaten).drop("others", "whole", "found")


def license_report(spark: SparkSession, docs: DataFrame) -> DataFrame:
    found = spans(spark, docs)
    base, none = F.col("base"), F.lit(None)

    def labels(which) -> F.Column:
        return F.concat_ws(",", F.array_sort(F.collect_set(F.when(which, F.col("label")).otherwise(none))))

    texts = found.groupBy("id", "th").agg(
        F.max("copies").alias("copies"),
        F.max("n_words").cast("long").alias("n_words"),
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("first"))).cast("long").alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("template").isNotNull()).alias("labels"),
        F.coalesce(F.max("coverage"), F.lit(0.0)).alias("score"),
    )
    # Rows alike were counted once; each gets its row again.
    return texts.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(
        F.col("id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"
    )


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_report(spark, table(spark, sf_dir, "documents"))
