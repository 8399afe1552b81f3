"""License scans (native: DataFrame functions and spark.ml only).

A paragraph (``\\n``-line) is classified by multinomial logistic regression on its sparse word n-grams (1 to 3). Training rows are variants of the notices below (seeded
loss of words, added words) for the families, and for the unknown class a bounded hash sample of the corpus's own paragraphs, sentences that speak of licences in general, and
the notices with their version changed to one that no family has. Every paragraph of every text is scored, without a shuffle: n-grams are hashed to 64 bits and a table of ``2**TABLE_BITS`` numbers
gives each one the most that it can add to any family's lead over the unknown class. Paragraphs whose sum can reach the cut (a bound, so none is lost) get their exact scores by a
join with the weights. The cut is calibrated: the ``1 - ALARMS`` quantile of the best family's probability over held-out unknown paragraphs, ``LEAST_P`` at least.
A prediction counts only if the comparison with its family's notices confirms it: one of them has at least ``LEAST_OVERLAP`` of its n-grams and all its deciding words in the paragraph.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordlink.llm import common

# ---- fixed values: licence families with the names in use, and notices as they stand in files ------
NAMES = {
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 license"),
    "MIT": ("MIT License", "MIT license"),
    "ISC": ("ISC License",),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License"),
    "GPL-2.0": ("GNU General Public License version 2", "GPL version 2", "GPLv 2"),
    "GPL-3.0": ("GNU General Public License version 3", "GPL version 3", "GPLv 3"),
    "LGPL-2.1": ("GNU Lesser General Public License version 2.1", "LGPL version 2.1"),
    "LGPL-3.0": ("GNU Lesser General Public License version 3", "LGPL version 3"),
    "AGPL-3.0": ("GNU Affero General Public License version 3", "AGPL version 3"),
    "MPL-2.0": ("Mozilla Public License, v. 2.0", "Mozilla Public License 2.0", "MPL 2.0"),
    "EPL-2.0": ("Eclipse Public License 2.0", "Eclipse Public License v. 2.0", "EPL 2.0"),
    "CDDL-1.0": ("Common Development and Distribution License 1.0", "CDDL 1.0"),
    "BSL-1.0": ("Boost Software License, Version 1.0", "Boost Software License 1.0"),
    "Zlib": ("zlib License",),
    "Unlicense": ("Unlicense",),
    "WTFPL": ("Do What The Fuck You Want To Public License", "WTFPL"),
    "Artistic-2.0": ("Artistic License 2.0",),
    "CC0-1.0": ("CC0 1.0 Universal license", "CC0 1.0"),
    "CC-BY-4.0": ("Creative Commons Attribution 4.0 International License", "CC BY 4.0"),
    "CC-BY-SA-4.0": ("Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 4.0"),
    "CC-BY-NC-4.0": ("Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0"),
    "CC-BY-ND-4.0": ("Creative Commons Attribution-NoDerivatives 4.0 International License", "CC BY-ND 4.0"),
    "CC-BY-NC-SA-4.0": ("Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "CC BY-NC-SA 4.0"),
    "CC-BY-NC-ND-4.0": ("Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License", "CC BY-NC-ND 4.0"),
}
PHRASES = ("licensed under the {}", "licensed under {}", "released under the {}", "released under {}", "distributed under the {}", "this work is licensed under a {}", "available under the terms of the {}", "this software is published under the {}")
IDENTIFIER = "spdx license identifier {}"
NOTICES = {
    "Apache-2.0": (
        "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    ),
    "MIT": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    ),
    "ISC": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",),
    "BSD-3-Clause": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    ),
    "GPL-2.0": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",),
    "GPL-3.0": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
    ),
    "LGPL-2.1": ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",),
    "LGPL-3.0": ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",),
    "AGPL-3.0": ("this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",),
    "MPL-2.0": ("this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",),
    "EPL-2.0": ("this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",),
    "CDDL-1.0": ("the contents of this file are subject to the terms of the common development and distribution license version 1 0 you may not use this file except in compliance with the license",),
    "BSL-1.0": ("permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software",),
    "Zlib": ("this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    "Unlicense": ("this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software",),
    "WTFPL": ("everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed",),
    "CC0-1.0": ("to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",),
}
#: Sentences that are no notice of a family above.
ABOUT = (
    "the license fee is due at the end of each month", "he lost his driving license last winter", "all rights reserved no part of this book may be reproduced", "copyright holders may object to the use of the name",
    "the company was licensed to sell food and drink", "a software license is a legal text", "this product is licensed not sold", "you need a license to fish in this river", "her work was published under a new name",
    "the terms of the agreement are available to any person", "the license was revoked by the court", "permission was granted to build the house", "the source code of the program is not public", "licensed under the terms of the agreement between the parties",
    "licensed under the microsoft public license", "released under the eiffel forum license version 2", "licensed under the sleepycat license", "released under the python software foundation license version 2", "licensed under the open database license",
    "licensed under the european union public licence version 1 2", "released under the academic free license version 3 0", "licensed under the q public license version 1 0", "released under the php license version 3 01", "licensed under the postgresql license",
)
#: Words that tell families with like notices apart: a notice that lacks one of these does not confirm a paragraph that has it.
DECIDING = ("sa", "nc", "nd", "sharealike", "noncommercial", "noderivatives", "lesser", "lgpl", "lgplv", "affero", "agpl", "agplv", "simplified", "new")
# --------------------------------------------------------------------------------------------------
UNKNOWN = "unknown"
VARIANTS = 12
UNKNOWN_ROWS = 4_000
LEAST_P, LEAST_OVERLAP, ALARMS = 0.5, 0.5, 0.005
TABLE_BITS = 18


def template_rows() -> list[tuple[str, int, str]]:
    """(family, number, text): each name in each phrase, the identifier, and the longer notices."""
    out = []
    for family, names in NAMES.items():
        texts = [p.format(n) for n in names for p in PHRASES] + [IDENTIFIER.format(family), *NOTICES.get(family, ())]
        out += [(family, i, t) for i, t in enumerate(dict.fromkeys(texts))]
    return out


def _words(text: Column) -> Column:
    """Lower-case runs of ASCII letters and of digits."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]+|[0-9]+"), F.lit(0))


def _grams(w: Column) -> Column:
    """Hashes of the distinct n-grams of 1 to 3 words; one that would run over the end is the shorter one again."""
    hashed = lambda n: F.transform(w, lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, n)]))
    return F.array_distinct(F.concat(hashed(1), hashed(2), hashed(3)))


def template_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(template_rows(), "family string, template int, text string")


def paragraphs(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, para, line): the lines of each text; null text has none."""
    lines = F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1))
    return docs.select(F.col(key).alias("doc_id"), lines.alias("para", "line"))


def unknown_sample(paras: DataFrame, most: int = UNKNOWN_ROWS) -> DataFrame:
    """(w, h): at most ``most`` different lines, those with the smallest hashes, without the ones that hold half of a notice's words.

    A first pass without a shuffle counts the lines; only hashes below a threshold that leaves four times as many as needed are made distinct.
    """
    hashed = paras.select(F.xxhash64("line").alias("h"), "line").filter("line <> ''")
    n, different = hashed.agg(F.count("*"), F.approx_count_distinct("h")).first()
    share = min(1.0, 4 * most / max(different, 1)) if n else 1.0
    few = hashed.filter(F.col("h") <= F.lit(min(2**63 - 1, int(share * 2**64) - 2**63)))
    picked = few.groupBy("h").agg(F.min("line").alias("line")).orderBy("h").limit(most)
    w = _words(F.col("line"))
    known = F.broadcast(template_table(paras.sparkSession).select(_words(F.col("text")).alias("t")))  # the notices above
    like = F.size(F.array_intersect("w", "t")) * 2 >= F.size(F.array_distinct("t"))
    rows = picked.select(w.alias("w"), "h").filter(F.size("w") > 0)
    return rows.join(known, like, "left_anti")


def _made(spark: SparkSession) -> DataFrame:
    """(family, v, w, noisy): variants of the notices, with words lost at random and with words added; and for the unknown class the sentences about licences, and notices of versions that no family has."""
    rows = [(f, t) for f, _, t in template_rows()]
    old = [(UNKNOWN, " ".join(str(int(x) + 5) if x.isdigit() else x for x in t.replace(".", " ").split())) for _, t in rows if any(x.isdigit() for x in t.replace(".", " ").split())]
    made = spark.createDataFrame([*rows, *old, *[(UNKNOWN, t) for t in ABOUT]], "family string, text string").withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(VARIANTS - 1)))).withColumn("w0", _words(F.col("text")))
    decides = lambda x: x.isin(*DECIDING) | x.rlike("^[0-9]+$")
    lost = F.filter("w0", lambda x, i: decides(x) | (F.pmod(F.xxhash64(F.col("v"), i, x), F.lit(100)) >= 12) | (F.col("v") == 0))
    noise = F.transform(F.sequence(F.lit(0), F.pmod(F.xxhash64("v", "text"), F.lit(4)).cast("int")), lambda i: F.translate(F.substring(F.md5(F.concat_ws("-", F.col("v").cast("string"), i.cast("string"), F.col("text"))), 1, 6), "0123456789", "ghijklmnop"))
    return made.select("family", "v", F.when(F.col("v") % 2 == 0, lost).otherwise(F.concat(lost, noise)).alias("w"), (F.col("v") % 2 != 0).alias("noisy"))


def train(spark: SparkSession, paras: DataFrame) -> tuple[DataFrame, DataFrame, list[float], float]:
    """(weights: gram, family, weight; biases: family, bias; the table of bounds; the least sum of bounds with which the cut can be reached), the cut being a column of biases."""
    rows = common.written(_made(spark).unionByName(unknown_sample(paras).select(F.lit(UNKNOWN).alias("family"), F.pmod("h", F.lit(10)).cast("int").alias("v"), "w", F.lit(False).alias("noisy"))), "license-rows")
    names = [*NAMES, UNKNOWN]
    label = F.array_position(F.array(*map(F.lit, names)), F.col("family")) - 1
    rows = rows.select("family", (F.col("v") % 5 == 4).alias("held"), label.cast("double").alias("label"), _grams(F.col("w")).cast("array<string>").alias("grams"), "noisy")
    plain = rows.filter("family <> 'unknown' and not noisy")
    counts = CountVectorizer(inputCol="grams", outputCol="features", binary=True, minDF=1, vocabSize=1 << 20).fit(plain)  # every n-gram of the notices and of what is left of them without some words
    data = common.written(counts.transform(rows).select("family", "held", "label", "features").repartition(8), "license-vectors")
    share = {r[0]: r[1] for r in rows.groupBy("family").count().collect()}  # one row per family
    weigh = F.create_map(*[F.lit(x) for f, n in share.items() for x in (f, (8000.0 if f == UNKNOWN else 1000.0) / n)])
    model = LogisticRegression(maxIter=40, regParam=5e-3, elasticNetParam=0.7, family="multinomial", weightCol="weight").fit(data.filter("not held").withColumn("weight", weigh[F.col("family")]))
    matrix, bias = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    p = F.array_max(F.slice(vector_to_array("probability"), 1, len(NAMES)))
    held = model.transform(data.filter("held and family = 'unknown'")).select(p.alias("p")).agg(F.percentile("p", 1 - ALARMS)).first()[0]
    cut = min(max(LEAST_P, held or 0.0), 0.99)
    lead = matrix[:-1] - matrix[-1]  # each family against the unknown class
    table = [0.0] * (1 << TABLE_BITS)
    most = lead.max(axis=0)
    for g, x in zip(counts.vocabulary, most):
        if x > 0:
            table[int(g) % (1 << TABLE_BITS)] += float(x)
    least = float(-(max(bias[:-1] - bias[-1])) + _logit(cut))
    weights = [(int(g), names[f], float(matrix[f][i])) for i, g in enumerate(counts.vocabulary) for f in range(len(names)) if abs(matrix[f][i]) > 1e-6]
    return spark.createDataFrame(weights, "gram long, family string, weight double"), spark.createDataFrame([(names[f], float(bias[f]), float(cut)) for f in range(len(names))], "family string, bias double, cut double"), table, least


def _logit(p: float) -> float:
    return math.log(p / (1 - p))


def can_reach(line: Column, table: list[float], least: float) -> Column:
    """Whether a line's n-grams can lift some family over the cut: the sum of their bounds from the table is at least ``least``. The words are bound to a lambda variable, so that they are made once."""
    numbers = F.split(F.lit(",".join(f"{x:.6g}" if x else "0" for x in table)), ",").cast("array<float>")  # folded to a constant by the optimizer
    total = lambda w: F.aggregate(_grams(w), F.lit(0.0), lambda s, g: s + F.get(numbers, F.pmod(g, F.lit(1 << TABLE_BITS)).cast("int")))
    return F.exists(F.array(_words(line)), lambda w: (F.size(w) > 0) & (total(w) >= least - 1e-3))


def license_scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per paragraph found: doc_id, para, family, probability, overlap. Null and empty texts have none; repeated rows are found alike (one row for equal doc_id and para); empty input gives an empty table. Other columns of ``docs`` are not read, so their names cannot clash."""
    spark = docs.sparkSession
    paras = paragraphs(docs, key, text)
    weights, biases, table, least = train(spark, paras)
    weights = common.written(weights, "license-weights")
    some = common.written(paras.filter(can_reach(F.col("line"), table, least)).select("doc_id", "para", _words(F.col("line")).alias("w")), "license-candidates")
    grams = some.select("doc_id", "para", "w", F.explode(_grams(F.col("w"))).alias("gram")).select("doc_id", "para", F.xxhash64("w").alias("k"), "gram")
    sums = grams.distinct().join(F.broadcast(weights), "gram").groupBy("doc_id", "para", "k", "family").agg(F.sum("weight").alias("s"))  # the weights are bounded by the notices
    wide = sums.groupBy("doc_id", "para", "k").agg(F.map_from_entries(F.collect_list(F.struct("family", "s"))).alias("s"))  # one entry per family
    b = biases.agg(F.map_from_entries(F.collect_list(F.struct("family", "bias"))).alias("b"), F.max("cut").alias("cut"))
    logits = F.transform(F.map_entries("b"), lambda e: F.struct((e["value"] + F.coalesce(F.element_at(F.col("s"), e["key"]), F.lit(0.0))).alias("z"), e["key"].alias("family")))
    z = wide.crossJoin(F.broadcast(b)).withColumn("z", logits).withColumn("top", F.array_max("z")["z"])
    total = F.aggregate("z", F.lit(0.0), lambda a, x: a + F.exp(x["z"] - F.col("top")))
    best = F.array_max(F.filter("z", lambda x: x["family"] != UNKNOWN))
    hit = z.select("doc_id", "para", "k", best["family"].alias("family"), (F.exp(best["z"] - F.col("top")) / total).alias("probability"), "cut").filter("probability > cut").drop("cut")
    temp = template_table(spark).select("family", _words(F.col("text")).alias("tw")).withColumn("tg", _grams(F.col("tw")))
    both = hit.join(some.select("doc_id", "para", "w").withColumn("k", F.xxhash64("w")).distinct(), ["doc_id", "para", "k"]).join(F.broadcast(temp), "family")
    decides = F.array(*map(F.lit, DECIDING))
    numbers = F.filter("tw", lambda x: x.rlike("^[0-9]+$"))
    agrees = (F.size(F.array_except(numbers, "w")) == 0) & (F.size(F.array_except(F.array_intersect("tw", decides), "w")) == 0)
    overlap = F.when(agrees, F.size(F.array_intersect(_grams(F.col("w")), "tg")) / F.size("tg"))
    out = both.groupBy("doc_id", "para", "family", "probability").agg(F.max(overlap).alias("overlap"))
    return out.filter(F.col("overlap") >= LEAST_OVERLAP)


def query(spark, sf_dir: str) -> DataFrame:
    return license_scan(common.table(spark, sf_dir, "documents"))
