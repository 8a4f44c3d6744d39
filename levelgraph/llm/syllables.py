"""Syllables of words by hyphenation-style rules: patterns of competing levels, as in Liang's algorithm.

A pattern is letters with digits between them, a dot for the word's beginning or end, and sets of letters in brackets. At
each place of a word the highest level of all patterns that match there counts: a syllable begins at a vowel where it is
odd. Without a pattern a vowel after a consonant has level 1; one after a vowel has level 0, or 1 in languages in which
two vowels belong to two syllables. A level from 3 up also counts before a consonant (rhyth-m).
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import product

VOWELS = {
    "en": "aeiouyàáâäèéêëìíîïòóôöùúûü",
    "de": "aeiouyäöüàáâèéêìíîòóôùúû",
    "es": "aeiouáéíóúü",
    "fr": "aeiouyàâäèéêëîïôöùûüœæ",
    "und": "aeiouyàáâãäåèéêëìíîïòóôõöøùúûüýœæ",
}
#: Languages in which a vowel after a vowel begins a syllable unless a pattern says otherwise.
APART = frozenset({"de"})

RULES = {
    # mute e, also before endings and in compounds; syllabic l and m; vowels apart and together
    "en": """
        2e. 2es. 2ed. [szcgx]3es. [cs]h3es. [td]3ed. [bcdfgkpstz]l3e. [bcdfgkpstz]l3es. [bcdfgkpstz]l3ed.
        2eful. 2eless. 2ely. 2ement. 2ements. 2eness. .r3ely. .el3ement pl3ement .c3ement [gq]2ue. [gq]2ues. [gq]2ued.
        som2e hom2ew ther2ef wher2ea not2eb bas2el tim2es lik2ew ev2ery ev2ening saf2ety bus2iness recip3e. astroph3e.
        apostroph3e. for2ecast mor2eo nin2et knowl2edge i3sm. i3sms. y3sm. th3m. th3ms.
        i1a [cts]i2a gi2an mili2ar i1o [ctsgx]i2o [ln]i2on shi2on i1u i1et i1enc i1ent ti2en ci2en .sci3en i1er. i1ers. i1est.
        .pi2er .ti2er cre1a cre2atur ide1a are1a re1ali .re1act line1a nucle1a the1at e1o pe2op ge2on .le2op .je2op e1um. e1ing
        .re1in .re1en .re1eva o1ing po1e .co1eff .co1op .co1ord .co1inc .zo1ol oa1si
        u1a [qgs]u2a u1el u1en u1et [qg]u2e u1ing u1o qu2o ru1in flu1id tu1it gu1it nu1it nu1in y1a y1e y1i y1o .y2[aeiou] ey2e
    """,
    # what belongs together; -ie and -ien of Latin words apart
    "de": """
        a2a e2e o2o i2e e2i a2i a2u e2u ä2u e2y a2y o2y o2i qu2[aeioäö] se3um de3en .be3ei .ge3ei .be3in .ge3in .be3ur .be3un .ge3ur
        [st]i3e. mili3e lini3e seri3e feri3e studi3e eri3en. edi3en ali3en ipi3en ori3en ani3en onti3 asi3e rani3 ni2eu tti2e
    """,
    # strong vowels apart, an accented weak one apart from a strong one; y between vowels isn't a vowel
    "es": """
        [aeoáéó]3[aeoáéó] [aeoáéó]3[íú] [íú]3[aeoáéó] y3. 3y. [aeou]4y.
    """,
    # mute e and -ent of verbs; vowels apart
    "fr": """
        2e. 2es. 2ent. m3ent. m3ents. i3ent. souv3ent. prés3ent. ér3ent. éc3ent. g3ent. id3ent. par3ent. al3ent. cont3ent. abs3ent. équ3ent.
        é3[aiouâ] é3er é3el a3ï o3ï a3ë o3ë a3é o3é o3è o3o pa3ys [bcdfgptv][lr]i3[aeoé] u3a [qg]u4a u3er. ou3er. [qg]u4er. ou3a ou3é
        y3[aeoé] .y4[aeo] i3um. oy4. ay4. éa4u
        [gq]2ue. [gq]2ues.
    """,
    "und": "",
}


def _patterns(text: str) -> dict[str, tuple[tuple[int, int], ...]]:
    """Letters of each pattern -> its levels, as (place, level); sets of letters are written out."""
    found: dict[str, dict[int, int]] = {}
    for rule in text.split():
        letters, levels, choices = 0, {}, []
        for token in re.findall(r"\d|\[[^\]]*\]|.", rule):
            if token.isdigit():
                levels[letters] = int(token)
            else:
                choices.append(token.strip("[]"))
                letters += 1
        for way in product(*choices):
            own = found.setdefault("".join(way), {})
            for at, level in levels.items():
                own[at] = max(level, own.get(at, 0))
    return {k: tuple(v.items()) for k, v in found.items()}


_PATTERNS = {lang: _patterns(text) for lang, text in RULES.items()}
_LONGEST = {lang: max(map(len, p), default=0) for lang, p in _PATTERNS.items()}


@lru_cache(200_000)
def syllables(word: str, lang: str) -> int:
    """Syllables of a lower-case word, at least 1; lang is a key of RULES."""
    vowels, patterns, longest = VOWELS[lang], _PATTERNS[lang], _LONGEST[lang]
    dotted = f".{word}."
    levels = [0] * (len(dotted) + 1)
    for i in range(len(dotted)):
        for j in range(i + 2, min(i + longest, len(dotted)) + 1):
            for at, level in patterns.get(dotted[i:j], ()):
                if level > levels[i + at]:
                    levels[i + at] = level
    n, before = 0, False
    for i, letter in enumerate(word, 1):
        vowel = letter in vowels
        level = levels[i] or (vowel and (not before or lang in APART))
        if level % 2 and (vowel or level > 2):
            n += 1
        before = vowel
    return max(1, n)
