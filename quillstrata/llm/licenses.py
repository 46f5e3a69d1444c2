"""License scans: a trained paragraph classifier, with template comparison.

A paragraph is a line of text with a word; scored lines one below the other are judged together, too (wrapped notices). The classifier is a multinomial logistic regression over sparse word 1- and
2-grams (lower-cased ASCII words), with one class for each licence family and one for anything else. It is trained on
the spot from the templates below (whole, halved and with words left out), windows of whole notices (the lines that they
may be wrapped to) and a bounded sample of at most
SAMPLE_ROWS ordinary paragraphs of the corpus, picked by hash: those that don't share OVERLAP of their 3-grams with a
template or notice, with cue words or without. The unknown class is calibrated by cross-fitting: the templates of each family are
dealt to two folds, and a model of one fold judges the whole templates and the ordinary paragraphs of the other, none of
which it has seen in any form. The bar on a family's probability is the lowest at which what reaches it is right in
PRECISION of cases. A prediction below the bar is unknown; one above it must be confirmed: the paragraph shares at least
OVERLAP of the word 3-grams of the smaller of it and one template or notice of that family. An unconfirmed one is unknown too, and
so is one that the model takes for ordinary text but that shares as much with a template.

Confirmation needs a 3-gram of a template, so the paragraphs that share one are scored, and besides those with a cue word,
which may read like a notice of no template here (unknown). The others could not be confirmed and their families stay as
they are.

Null text has no paragraphs. Repeated rows get a row each. Ties between families go to the first in the order of names.
An empty table gives an empty result; without ordinary paragraphs the templates alone train the model. The weights that are
broadcast are bounded by the templates' n-grams: VOCABULARY rows at most.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstrata.llm.common import cut, text_or_empty, text_key

SAMPLE_ROWS = 2_000
VOCABULARY = 8_192
OVERLAP = 0.6
PRECISION = 0.99
OTHER = "other"

# Sentences of licences and of their usual notices, by family.
TEMPLATES = {
    "agpl": ("Licensed under the GNU Affero General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.", "SPDX-License-Identifier: AGPL-3.0-or-later"),
    "apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.", "SPDX-License-Identifier: Apache-2.0"),
    "bsd": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "Released under the BSD License.", "Licensed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"),
    "cc-by": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0"),
    "cc0": ("Licensed under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work and dedicated it to the public domain.", "SPDX-License-Identifier: CC0-1.0"),
    "gpl": ("This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 2 or later.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.", "You should have received a copy of the GNU General Public License along with this program.", "SPDX-License-Identifier: GPL-3.0-or-later"),
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Released under the ISC License.", "SPDX-License-Identifier: ISC"),
    "lgpl": ("Licensed under the GNU Lesser General Public License, version 3.", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.", "SPDX-License-Identifier: LGPL-3.0-or-later"),
    "mit": ("Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "SPDX-License-Identifier: MIT"),
    "mpl": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0"),
    "proprietary": ("All rights reserved.", "All rights reserved. Unauthorized copying, distribution or use of this material without written permission is prohibited.", "This document is confidential and proprietary; no license to use it is granted."),
    "public-domain": ("This is free and unencumbered software released into the public domain without copyright.", "This work has been released into the public domain; no copyright is claimed."),
}
# Whole notices, as they stand at the head of files, by family.
NOTICES = {
    "agpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. "
        "You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."
    ),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
        "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "gpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. "
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER "
        "RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. "
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. "
        "You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation."
    ),
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
        "and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
        "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}
#: Words of a notice's windows that train the model, as lines that it may be wrapped to, and how far apart they begin.
WINDOW, STEP = 12, 5
# Stems of notices.
CUES = ("licen", "copyright", "permission", "warrant", "redistribut", "public domain", "rights reserved")
CUE = "(?i)" + "|".join(CUES)


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^a-z0-9]+", -1), lambda w: w != "")


def ngrams(words: Column, n: int) -> Column:
    places = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.array_join(F.slice(words, i, n), " "))


def grams(words: Column) -> Column:
    return F.array_distinct(F.concat(words, ngrams(words, 2)))


def _words(text: str) -> list[str]:
    """tokens() of a template."""
    return re.findall("[a-z0-9]+", text.lower())


def _windows(notice: str) -> list[str]:
    """Windows of a notice, the last one at its end."""
    w = _words(notice)
    starts = [*range(0, max(1, len(w) - WINDOW), STEP), max(0, len(w) - WINDOW)]
    return list(dict.fromkeys(" ".join(w[i : i + WINDOW]) for i in starts))


#: (family, text): what a confirmed line must share 3-grams with.
KNOWN = [*((f, x) for f, texts in TEMPLATES.items() for x in texts), *NOTICES.items()]
TRIGRAMS = sorted({" ".join(w[i : i + 3]) for _, text in KNOWN for w in [_words(text)] for i in range(len(w) - 2)})
FIRST_WORDS = sorted({x.split(" ")[0] for x in TRIGRAMS})


def notice_like(line: Column) -> Column:
    """Has a cue word, or shares a word 3-gram with a template."""
    # Most words start no 3-gram of a template; whole 3-grams are made for the others only. The words are bound once.
    places = lambda w: F.sequence(F.lit(1), F.greatest(F.size(w) - 2, F.lit(1)))
    at = lambda w, i: F.get(w, i)
    same = lambda w: F.exists(places(w), lambda i: at(w, i - 1).isin(FIRST_WORDS) & F.concat_ws(" ", at(w, i - 1), at(w, i), at(w, i + 1)).isin(TRIGRAMS))
    return line.rlike(CUE) | F.coalesce(F.get(F.transform(F.array(tokens(line)), same), F.lit(0)), F.lit(False))


def _rows(spark, rows: list[tuple[str, str, int]]) -> DataFrame:
    """family, text, fold as a table."""
    made = [F.struct(F.lit(family).alias("family"), F.lit(text).alias("text"), F.lit(fold).alias("fold")) for family, text, fold in rows]
    return spark.range(1).select(F.explode(F.array(*made)).alias("x")).select("x.*")


def _template_rows(spark) -> DataFrame:
    """family, text, fold: templates of a family are dealt to two folds in turn."""
    return _rows(spark, [(family, text, i % 2) for family, texts in TEMPLATES.items() for i, text in enumerate(texts)])


def _window_rows(spark) -> DataFrame:
    """family, fold, w, whole: whole notices and their windows; those that two families share teach neither."""
    of: dict[str, set[str]] = {}
    for family, notice in NOTICES.items():
        for x in (" ".join(_words(notice)), *_windows(notice)):
            of.setdefault(x, set()).add(family)
    rows = [(next(iter(f)), x, i % 2) for i, (x, f) in enumerate(of.items()) if len(f) == 1]
    return _rows(spark, rows).select("family", "fold", F.split("text", " ").alias("w"), F.lit(True).alias("whole"))


def _variants(templates: DataFrame) -> DataFrame:
    """family, fold, w, whole: templates whole, in halves, and nine times with about a sixth of the words left out."""
    words = templates.withColumn("w", tokens(F.col("text")))
    half = F.ceil(F.size("w") / 2).cast("int")
    halves = words.select("family", "fold", F.explode(F.array(F.struct("w", F.lit(True).alias("whole")), *(F.struct(F.slice("w", a, half).alias("w"), F.lit(False).alias("whole")) for a in (F.lit(1), half + 1)))).alias("x")).select("family", "fold", "x.*")
    thinned = words.withColumn("id", F.explode(F.sequence(F.lit(0), F.lit(8))))
    left = thinned.select("family", "fold", F.filter("w", lambda x, i: F.pmod(F.xxhash64(x, i, F.col("id")), F.lit(6)) > 0).alias("w"), F.lit(False).alias("whole"))
    return halves.union(left).where((F.size("w") >= 4) | F.col("whole"))


def paragraphs(docs: DataFrame) -> DataFrame:
    """docs with lines: array of struct i (place in the text), line, of the lines with a word."""
    placed = F.transform(F.split(text_or_empty(), "\n", -1), lambda x, i: F.struct(i.alias("i"), x.alias("line")))
    return docs.withColumn("lines", F.filter(placed, lambda x: x["line"].rlike(r"[^\x20\x09-\x0D]")))


class LicenseModel:
    """Weights of the classifier as a small table (gram, w: a weight a class), biases, classes and the bar."""

    def __init__(self, weights: DataFrame, bias: list[float], classes: list[str], bar: float):
        self.weights, self.bias, self.classes, self.bar = weights, bias, classes, bar


def _fitted(data: DataFrame, counted, classes: list[str]):
    """A model of rows (label, features); one row without grams keeps the class of ordinary text where there are none."""
    blank = counted.transform(data.sparkSession.range(1).select(F.lit(float(len(classes) - 1)).alias("label"), F.array().cast("array<string>").alias("grams"))).select("label", "features")
    return LogisticRegression(family="multinomial", regParam=0.002, elasticNetParam=0.0, maxIter=60).fit(data.select("label", "features").union(blank).coalesce(1))


def train(ordinary: DataFrame) -> LicenseModel:
    """ordinary: a column line of paragraphs; at most SAMPLE_ROWS of those that match no template are used."""
    spark = ordinary.sparkSession
    classes = [*sorted(TEMPLATES), OTHER]
    templates = _template_rows(spark)
    picked = cut(ordinary.orderBy(F.xxhash64("line"), "line").limit(SAMPLE_ROWS).withColumn("n", F.monotonically_increasing_id()))
    few = picked.join(_confirmed(picked.select(F.col("n").alias("r"), F.lit(0).alias("j"), "line", F.lit("").alias("family")), any_family=True), F.col("n") == F.col("r"), "left_anti")
    own = few.select(F.lit(OTHER).alias("family"), F.pmod(F.xxhash64("line", F.lit(1)), F.lit(2)).cast("int").alias("fold"), F.slice(tokens(F.col("line")), 1, 60).alias("w"), F.lit(True).alias("whole"))
    place = F.array_position(F.array(*map(F.lit, classes)), F.col("family")) - 1
    # SAMPLE_ROWS and the templates bound these rows, and every step of a fit is a job over them: one task each.
    labelled = cut(_variants(templates).unionByName(_window_rows(spark)).unionByName(own).select(place.cast("double").alias("label"), "fold", "whole", grams(F.col("w")).alias("grams")).coalesce(1))
    counted = CountVectorizer(inputCol="grams", outputCol="features", vocabSize=VOCABULARY, minDF=2.0, binary=True).fit(labelled.where("label < " + str(len(classes) - 1)))
    data = cut(counted.transform(labelled).select("label", "fold", "whole", "features"))
    points: dict[int, list[int]] = {}
    for fold in (0, 1):
        judged = _fitted(data.where(F.col("fold") != fold), counted, classes).transform(data.where((F.col("fold") == fold) & F.col("whole")))
        seen = judged.select("label", "prediction", F.array_max(vector_to_array("probability")).alias("p")).where(F.col("prediction") < len(classes) - 1)
        for r in seen.groupBy(F.floor(F.col("p") * 100).alias("at")).agg(F.count("*").alias("n"), F.sum((F.col("label") == F.col("prediction")).cast("int")).alias("right")).collect():
            n, right = points.get(r["at"], (0, 0))
            points[r["at"]] = (n + r["n"], right + r["right"])
    bar = 0.99
    for at in range(99, 29, -1):
        above = [x for place_, x in points.items() if place_ >= at]
        if above and sum(x[1] for x in above) >= PRECISION * sum(x[0] for x in above):
            bar = at / 100
    model = _fitted(data, counted, classes)
    matrix, bias = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    weights = spark.createDataFrame([(gram, [float(x) for x in matrix[:, i]]) for i, gram in enumerate(counted.vocabulary)], "gram string, w array<double>")
    return LicenseModel(weights, [float(x) for x in bias], classes, bar)


def _classified(cued: DataFrame, model: LicenseModel) -> DataFrame:
    """cued: r (row key), j, line. Adds family and p."""
    k = len(model.classes)
    hits = cued.select("r", "j", F.explode(grams(tokens(F.col("line")))).alias("gram")).join(F.broadcast(model.weights), "gram")
    sums = hits.groupBy("r", "j").agg(F.array(*(F.sum(F.col("w")[i]) + model.bias[i] for i in range(k))).alias("z"))
    top = F.array_max("z")
    share = F.lit(1.0) / F.aggregate("z", F.lit(0.0), lambda a, z: a + F.exp(z - top))
    return sums.select("r", "j", F.element_at(F.array(*map(F.lit, model.classes)), F.array_position("z", top).cast("int")).alias("family"), share.alias("p"))


def _confirmed(lines: DataFrame, any_family: bool = False) -> DataFrame:
    """r, j of predicted lines that share enough 3-grams with a template of their family, or of any."""
    templates = _rows(lines.sparkSession, [(f, x, 0) for f, x in KNOWN]).withColumn("t", F.monotonically_increasing_id())
    known = templates.select("family", "t", F.array_distinct(ngrams(tokens(F.col("text")), 3)).alias("g")).select("family", "t", F.size("g").alias("n_t"), F.explode("g").alias("gram"))
    own = lines.select("r", "j", F.col("family").alias("said"), F.array_distinct(ngrams(tokens(F.col("line")), 3)).alias("g")).select("r", "j", "said", F.size("g").alias("n_g"), F.explode("g").alias("gram"))
    met = own.join(F.broadcast(known), "gram").where(F.lit(any_family) | (F.col("said") == F.col("family")))
    shared = met.groupBy("r", "j", "t").agg(F.count("*").alias("n"), F.least(F.first("n_g"), F.first("n_t")).alias("least"))
    return shared.where(F.col("n") >= OVERLAP * F.col("least")).select("r", "j").distinct()


def _blocks(lines: DataFrame) -> DataFrame:
    """lines: r, i (place in the text), j, line. Adds block: the first j of the run of lines, one below the other, that a line is in."""
    along = Window.partitionBy("r").orderBy("i")
    island = lines.withColumn("island", F.col("i") - F.row_number().over(along))
    return island.withColumn("block", F.min("j").over(Window.partitionBy("r", "island"))).drop("island")


def license_verdicts(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_paragraphs, n_cued, families (confirmed ones, sorted, comma-joined), n_confirmed, n_unknown.

    n_cued: paragraphs that were scored. n_unknown: paragraphs that read like a licence notice, by the model or by a template's
    3-grams, but are below the bar or match no template of the predicted family. Lines that stand one below the other may be
    one notice that was wrapped: they are judged together, too, and a line that is unknown by itself is confirmed with them.
    """
    _, k2 = text_key(text_or_empty())
    split = paragraphs(docs.select("doc_id", "text"))
    cued = F.filter("lines", lambda x: notice_like(x["line"]))
    # The lines of a hash-picked few rows stand for ordinary text.
    some = F.when(F.pmod(k2, F.lit(64)) == 0, F.slice("lines.line", 1, 4))
    rows = cut(split.select("doc_id", F.size("lines").cast("long").alias("n_paragraphs"), cued.alias("cued"), some.alias("some")).withColumn("r", F.monotonically_increasing_id()))
    model = train(rows.select(F.explode("some").alias("line")))
    lines = cut(_blocks(rows.select("r", F.posexplode("cued").alias("j", "x")).select("r", "j", "x.i", "x.line")))
    # Blocks of several lines go along as lines of their own, with negative numbers.
    wrapped = lines.groupBy("r", "block").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list(F.struct("j", "line")))["line"], " ").alias("line")).where("n > 1").select("r", (-1 - F.col("block")).alias("j"), "line")
    judged = lines.select("r", "j", "line").unionByName(wrapped)
    scored = cut(_classified(judged, model).join(judged, ["r", "j"]))
    # A part of a template that the model takes for ordinary text still reads like a notice.
    other = scored.where(F.col("family") == OTHER)
    found = cut(scored.where(F.col("family") != OTHER).union(other.join(_confirmed(other, any_family=True), ["r", "j"], "left_semi").select(*scored.columns)))
    sure = found.where((F.col("family") != OTHER) & (F.col("p") >= model.bar))
    good = cut(_confirmed(sure).join(sure.select("r", "j", "family"), ["r", "j"]))
    own = good.where("j >= 0").select("r", "j", F.col("family").alias("own"))
    whole = good.where("j < 0").select("r", (-1 - F.col("j")).alias("block"), F.col("family").alias("whole"))
    each = cut(found.where("j >= 0").select("r", "j").join(lines.select("r", "j", "block"), ["r", "j"]).join(own, ["r", "j"], "left").join(whole, ["r", "block"], "left"))
    # A line that fits the notice around it is part of that one, even if it reads like a sibling's by itself.
    fits = _confirmed(each.where("whole IS NOT NULL").join(lines.select("r", "j", "line"), ["r", "j"]).withColumn("family", F.col("whole"))).withColumn("fits", F.lit(True))
    said = each.join(fits, ["r", "j"], "left").withColumn("said", F.when(F.col("fits"), F.col("whole")).otherwise(F.coalesce("own", "whole")))
    per = said.groupBy("r").agg(F.array_join(F.array_sort(F.collect_set("said")), ",").alias("families"), F.count("said").alias("n_confirmed"), F.count_if(F.col("said").isNull()).alias("n_unknown"))
    zero = F.lit(0).cast("long")
    return rows.join(per, "r", "left").select("doc_id", "n_paragraphs", F.size("cued").cast("long").alias("n_cued"), F.coalesce("families", F.lit("")).alias("families"), F.coalesce("n_confirmed", zero).alias("n_confirmed"), F.coalesce("n_unknown", zero).alias("n_unknown"))
