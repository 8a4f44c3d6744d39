"""Reading level of each document: classic readability formulas, combined by their median."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import require_columns
from ..workspace import Workspace
from .notebook_text import prose_paragraphs
from .syllables import syllables

#: A word; scripts without spaces between words count each sign.
_WORD = re.compile(r"[\u3040-\u30ff\u3400-\u9fff]|[^\W\d_\u3040-\u30ff\u3400-\u9fff]+(?:['’][^\W\d_]+)*")
_END = re.compile(r"[.!?…:;]+(?=\s|$)|[。！？]+")

# The most frequent words of languages, as general frequency lists have them.
COMMON_WORDS = {
    "en": "the of and to a in is that it for as was with be by on not he his but at are this have from or had an they which one you were all she there would their we him been has when who will no more if out so what",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy hasta desde está mi porque",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec ont aux mais comme ou si leur y elle cette nous vous être son sa ses lui fait tout je été même",
    "it": "di e il la che in a per un è non del le una i con si da della dei al lo ha sono come più anche alla gli ma nel dalla questo su delle ci se era o loro suo essere stato perché",
    "pt": "de a o que e do da em um para é com não uma os no se na por mais as dos como mas foi ao ele das tem à seu sua ou ser quando muito há nos já está eu também só pelo pela até",
    "nl": "de van het een en in is dat op te zijn met voor niet aan er om ook als bij maar dan of uit hij had naar door worden nog over wordt ze deze was dit ik je wel geen meer tot",
}
_COMMON = {k: frozenset(v.split()) for k, v in COMMON_WORDS.items()}
_SHARED = Counter(w for own in _COMMON.values() for w in own)
#: Languages that have rules and formulas of their own; a text of any other, or of none that is known, is UNKNOWN.
LANGUAGES, UNKNOWN = ("en", "de", "es", "fr"), "und"
#: Share of a text's words that are frequent ones of its language, at least.
LEAST_COMMON = 0.04


def language_of(words: list[str]) -> str:
    """One of LANGUAGES, or UNKNOWN: whose frequent words are most frequent here, a word of several counting less."""
    n = Counter(words)
    score = {k: sum(n[w] / _SHARED[w] for w in own if w in n) for k, own in _COMMON.items()}
    best = max(score, key=score.get)
    return best if best in LANGUAGES and score[best] >= LEAST_COMMON * max(1, len(words)) else UNKNOWN


#: Measures of a document, from which the grades follow.
MEASURES = ["n_words", "n_sentences", "n_syllables", "n_letters", "n_long", "n_hard", "n_short"]


def measure(text: str | None) -> tuple[str, list[int]]:
    """Language and MEASURES of a document's prose; n_long has words of over six letters, n_hard those of three syllables
    or more, n_short those of one."""
    words, sentences = [], 0
    for p in prose_paragraphs(text):
        found = _WORD.findall(p.lower())
        if found:
            words += found
            sentences += max(1, sum(1 for part in _END.split(p) if _WORD.search(part)))
    lang = language_of(words)
    syl = [syllables(w, lang) for w in words]
    return lang, [len(words), sentences, sum(syl), sum(map(len, words)), sum(len(w) > 6 for w in words), sum(s >= 3 for s in syl), sum(s == 1 for s in syl)]


def _along(x: np.ndarray, at: tuple, grade: tuple) -> np.ndarray:
    """A table of a formula's author read as a line, which goes on beyond its ends as it goes at them."""
    at, grade = np.array(at, float), np.array(grade, float)
    k = np.clip(np.searchsorted(at, x) - 1, 0, len(at) - 2)
    return grade[k] + (x - at[k]) * (grade[k + 1] - grade[k]) / (at[k + 1] - at[k])


def _ease(score: np.ndarray) -> np.ndarray:
    """School grade of a reading ease: the middles of Flesch's bands, very easy (grade 5) to very difficult (graduate)."""
    return _along(score, (15, 40, 55, 65, 75, 85, 95), (17, 14, 11, 8.5, 7, 6, 5))


def _rix(long_per_sentence: np.ndarray) -> np.ndarray:
    """School grade of RIX, the long words of a sentence, by Anderson's table (1983)."""
    return _along(long_per_sentence, (0.2, 0.5, 0.8, 1.3, 1.8, 2.4, 3.0, 3.7, 4.5, 5.3, 6.2, 7.2), tuple(range(2, 14)))


def grades(m: np.ndarray, lang: str) -> np.ndarray:
    """Grade estimates (rows x formulas of the language) from MEASURES.

    The numbers are the formulas' published coefficients (fixed values). English: Flesch-Kincaid, Gunning fog, SMOG,
    Coleman-Liau, ARI. German: Flesch after Amstad, the first Wiener Sachtextformel, SMOG after Bamberger and Vanecek.
    Spanish: Flesch after Fernández Huerta, Crawford, SOL. French: Flesch after Kandel and Moles, SOL. All: RIX. A text
    of another language has those of English.
    """
    words, sentences, syl, letters, long, hard, short = np.maximum(m, [1, 1, 0, 0, 0, 0, 0]).T
    per_sentence, letters_w, syl_w = words / sentences, letters / words, syl / words
    hard_30 = np.sqrt(hard * 30 / sentences)
    smog, rix = 1.0430 * hard_30 + 3.1291, _rix(long / sentences)
    if lang == "de":
        wiener = 0.1935 * 100 * hard / words + 0.1672 * per_sentence + 0.1297 * 100 * long / words - 0.0327 * 100 * short / words - 0.875
        found = [_ease(180 - per_sentence - 58.5 * syl_w), wiener, hard_30 - 2, rix]
    elif lang == "es":
        crawford = -0.205 * 100 / per_sentence + 0.049 * 100 * syl_w - 3.407
        found = [_ease(206.84 - 60 * syl_w - 1.02 * per_sentence), crawford, 0.74 * smog - 2.51, rix]
    elif lang == "fr":
        found = [_ease(207 - 1.015 * per_sentence - 73.6 * syl_w), 0.83 * smog - 0.35, rix]
    else:
        coleman_liau = 0.0588 * 100 * letters_w - 0.296 * 100 * sentences / words - 15.8
        found = [
            0.39 * per_sentence + 11.8 * syl_w - 15.59, 0.4 * (per_sentence + 100 * hard / words), smog, coleman_liau,
            4.71 * letters_w + 0.5 * per_sentence - 21.43, rix,
        ]
    return np.column_stack(found)


def grade_of(found: list[tuple[str, list[int]]]) -> np.ndarray:
    """The median of the estimates of each measured document, NaN without words."""
    m = np.array([x[1] for x in found], float).reshape(-1, len(MEASURES))
    lang, out = np.array([x[0] for x in found], object), np.full(len(found), np.nan)
    for k in (*LANGUAGES, UNKNOWN):
        here = (lang == k) & (m[:, 0] > 0)
        if here.any():
            out[here] = np.median(grades(m[here], k), axis=1)
    return out


#: Labelled rows that the cut points are fitted on, at most: those of least hash.
MOST_LABELS = 20_000
#: Weight of each label of another language beside those of a language's own, and of all of them together at most, as
#: the formulas' scales differ between languages.
POOLED, MOST_POOLED = 0.05, 5.0
#: Labels that a cut must win for leaving the middle between two levels' medians by their distance.
PULL = 6
LEVELS = 5


def measured(documents: DataFrame) -> DataFrame:
    """(doc_id, lang, n_words, n_sentences, grade) of each document; grade is null without words.

    A null or empty text has no words; texts of any length are read whole. Extra columns are ignored.
    """
    require_columns(documents, "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [measure(t.as_py()) for t in b.column(1)]
            m = np.array([x[1] for x in found], np.int64).reshape(-1, len(MEASURES))
            grade, none = grade_of(found), m[:, 0] == 0
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": b.column(0),
                    "lang": pa.array([None if x else y[0] for x, y in zip(none, found)], pa.string()),
                    "n_words": pa.array(m[:, 0]),
                    "n_sentences": pa.array(m[:, 1]),
                    "grade": pa.array(grade, pa.float64(), mask=none),
                }
            )

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang string, n_words long, n_sentences long, grade double")


def _median(x: np.ndarray, weight: np.ndarray) -> float:
    half = np.cumsum(weight) / weight.sum()
    return float(x[min(np.searchsorted(half, 0.5), len(x) - 1)])


def fit_cuts(grade: np.ndarray, level: np.ndarray, lang: np.ndarray) -> dict[str, list[float]]:
    """For each language the LEVELS - 1 ascending grades between levels that put the fewest labels on the wrong side.

    The language's own labels decide, those of all others weigh POOLED as much, and MOST_POOLED labels together at most. As labels may be one level off, a
    penalty of PULL labels pulls a cut to the middle between the medians of the two levels. A level without labels is cut at the school grades (fixed
    values) that primary, secondary, college and specialist texts begin with.
    """
    cuts: dict[str, list[float]] = {}
    order = np.argsort(grade, kind="stable")
    g, lv, la = grade[order], level[order], lang[order]
    for k in (*LANGUAGES, UNKNOWN):
        own = la == k
        weight = np.where(own, 1.0, min(POOLED, MOST_POOLED / max(1, (~own).sum())))
        found = []
        for low, school in zip(range(1, LEVELS), (3.0, 6.0, 10.0, 15.0)):
            a, b = lv == low, lv == low + 1
            if not a.any() or not b.any():
                found.append(school)
                continue
            low_mid, high_mid = _median(g[a], weight[a]), _median(g[b], weight[b])
            places = np.r_[g[0] - 1, (g[1:] + g[:-1]) / 2, g[-1] + 1]
            above, below = weight * (lv > low), weight * (lv <= low)
            wrong = np.r_[0, np.cumsum(above)] + below.sum() - np.r_[0, np.cumsum(below)]
            cost = wrong + PULL * np.abs(places - (low_mid + high_mid) / 2) / max(high_mid - low_mid, 1e-6)
            found.append(float(places[np.argmin(cost)]))
        cuts[k] = [float(x) for x in np.maximum.accumulate(found)]
    return cuts


def reading_levels(documents: DataFrame, labels: DataFrame, least_words: int = 40, most_labels: int = MOST_LABELS) -> DataFrame:
    """(doc_id, lang, n_words, n_sentences, grade, reading_level) of every document.

    grade is the median of the language's readability formulas over the prose of the text cells; reading_level (1 to
    LEVELS) is told from it by cut points of the text's language, fitted on labels (doc_id, reading_level), at most
    ``most_labels`` of them. lang is UNKNOWN for a language without formulas; its cut points come from all labels. Labels that are null, out of range, repeated for other levels or of unknown documents do no harm. Documents
    with fewer than ``least_words`` words of prose have a null level. Repeated documents are read each for itself.
    """
    require_columns(labels, "doc_id", "reading_level")
    spark = documents.sparkSession
    docs = Workspace(spark, "reading").save(measured(documents), "measured")
    there = labels.where(f"reading_level between 1 and {LEVELS} and doc_id is not null").select("doc_id", "reading_level")
    known = docs.where(F.col("n_words") >= least_words).join(there, "doc_id")
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id", "reading_level").limit(most_labels).select("grade", "reading_level", "lang").toPandas()
    cuts = fit_cuts(sample["grade"].to_numpy(float), sample["reading_level"].to_numpy(int), sample["lang"].to_numpy(object))
    level = F.lit(None).cast("int")
    for k, found in cuts.items():
        here = sum((F.col("grade") > F.lit(float(c))).cast("int") for c in found) + F.lit(1)
        level = F.when(F.col("lang") == k, here).otherwise(level)
    return docs.withColumn("reading_level", F.when(F.col("n_words") >= least_words, level))
