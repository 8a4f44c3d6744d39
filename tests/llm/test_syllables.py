import pytest

from levelgraph.llm.syllables import RULES, syllables

# Words and their syllables, as dictionaries divide them.
WORDS = {
    "en": """a:1 the:1 every:2 business:2 create:2 creation:3 science:2 scientific:4 idea:3 people:2 something:2 sometimes:2 being:2 quiet:2
        special:2 social:2 table:2 tables:2 little:2 example:3 notebook:2 baseline:2 make:1 makes:1 boxes:2 changes:2 wanted:2 needed:2 worked:1
        settled:2 rhythm:2 algorithm:4 radio:3 nation:2 region:2 million:2 opinion:3 various:3 precious:2 material:4 partial:2 media:3 medium:3
        society:4 variety:4 patient:2 client:2 gradient:3 efficient:3 audience:3 friend:1 field:1 piece:1 earlier:3 linear:3 area:3 reality:4
        theory:3 video:3 geometry:4 museum:3 going:2 doing:2 choice:1 poem:2 coefficient:4 actual:3 manual:3 evaluate:4 language:2 square:1
        value:2 true:1 fuel:2 influence:3 sequence:2 question:2 build:1 fluid:2 fruit:1 continuous:4 beyond:2 you:1 year:1 eyes:1 player:2
        studying:3 movement:2 element:3 statement:2 lonely:2 useful:2 hopeless:2 technique:2 league:1 variable:4 dialogue:3 probability:5
        distribution:4 regression:3 estimate:3 parameter:4 significant:4 data:2 curve:1 house:1 garden:2 yellow:2 everyone:3 safety:2 therefore:2""",
    "de": """aktion:3 nation:3 bayern:2 der:1 ein:1 eine:2 haus:1 häuser:2 bauer:2 neue:2 idee:2 ideen:3 sehen:2 familie:4 linie:3 linien:3 studie:3
        studien:3 theorie:3 energie:3 industrie:3 medien:3 kriterien:4 italien:4 quelle:2 quadrat:2 aktuell:3 museum:3 beobachtung:4 geändert:3
        beeinflussen:4 ingenieur:3 union:3 variable:4 spielen:2 weil:1 feuer:2 euro:2 bäume:2 verteilung:3 unabhängig:4 regressionsmodell:6
        wahrscheinlichkeit:4 stichprobe:3 daten:2 häufigkeit:3 mittelwert:3 boot:1 see:1 tee:1 kaffee:2 radio:3 region:3 funktion:3 zwei:1""",
    "es": """país:2 el:1 que:1 guerra:2 agua:2 cielo:2 ciudad:2 poeta:3 aéreo:4 día:2 río:2 tío:2 continuo:3 leer:2 creación:3 nación:2 situación:3
        distribución:4 buey:1 muy:1 rey:1 ley:1 mayo:2 ahora:3 pingüino:3 estadística:5 probabilidad:5 muestra:2 huerta:2 idea:3 museo:3 línea:3
        teoría:4 raíz:2 baúl:2 y:1 hay:1 escuela:3 cuatro:2 bueno:2 pueblo:2 análisis:4 variable:3 oído:3 peine:2 causa:2 realidad:4""",
    "fr": """le:1 table:1 tables:1 nation:2 créer:2 théâtre:2 réel:2 noël:2 naïf:2 pays:2 payer:2 voyage:2 crayon:2 yeux:1 client:2 moment:2 donnent:1
        montrent:1 présent:2 souvent:2 idée:2 idées:2 eau:1 beau:1 oui:1 nuage:2 question:2 quatre:1 guerre:1 coopération:5 société:3 poème:2
        réunion:3 variable:2 distribution:4 régression:3 mesure:2 valeur:2 jardin:2 évaluer:4 jouer:2 probabilité:5 estimation:4 analyse:3
        modèle:2 données:2 lumière:2 chapeau:2 aérien:3 logique:2 langue:1 ouvrier:3 différent:3""",
}


@pytest.mark.parametrize("lang", WORDS)
def test_as_dictionaries_have_it(lang):
    words = [(w, int(n)) for w, n in (x.split(":") for x in WORDS[lang].split())]
    wrong = [(w, syllables(w, lang), n) for w, n in words if syllables(w, lang) != n]
    assert len(wrong) <= 0.05 * len(words), wrong


def test_levels_compete():
    assert [syllables(w, "en") for w in ("create", "creature", "theater", "rely", "likely")] == [2, 2, 3, 2, 2]
    assert syllables("", "en") == syllables("brr", "de") == syllables("数", "und") == 1
    assert syllables("banana", "und") == 3 and all(len(text.split()) < 200 for text in RULES.values())
