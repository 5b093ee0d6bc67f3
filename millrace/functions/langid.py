"""Language of a text: a detector gives a code or null for unknown.

Two detectors: function words, which need nothing, and profiles of letters, which are learned from labelled texts.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import normalize

#: Function words; chosen among those that other languages of the list lack.
WORDS = {
    "en": "the and of to is that for with are was be this not have from you your they which will".split(),
    "sw": "ya wa na kwa ni katika za la kama hii au yako wako ili cha kuwa hiyo wakati lakini pia".split(),
    "fr": "le les des est une dans pour que qui sur avec pas vous par ce sont au aux du et".split(),
    "de": "der die und das ist nicht ein eine mit den von zu auf für im dem auch sich wir werden".split(),
    "es": "el los las una por con para está como más pero sus del son ser sobre este también muy y".split(),
}


def detect(c: Column, least: int = 2, words: dict[str, list[str]] = WORDS) -> Column:
    """Language with the most function words, if it has `least` of them and no other has as many.

    Null for texts under ten characters and where there is no clear winner.
    """
    text = F.lower(normalize(c))
    every = sorted({w for own in words.values() for w in own})

    def known(text: Column) -> Column:
        tokens = F.split(F.regexp_replace(text, r"(?![a-z ])[^\p{L} ]", ""), " ")
        return F.filter(tokens, lambda w: w.isin(every))  # one look-up in a set; only what it leaves is looked for by language

    def ranked(found: Column) -> Column:
        hits = lambda k: F.size(F.filter(found, lambda w: w.isin(words[k])))
        return F.sort_array(F.array(*(F.struct(hits(k).alias("n"), F.lit(k).alias("lang")) for k in words)), False)

    def winner(r: Column) -> Column:
        return F.when((r[0]["n"] >= least) & (r[0]["n"] > r[1]["n"]), r[0]["lang"])

    # each step is the variable of a lambda, so that it is made once for a row
    given = lambda value, then: F.get(F.transform(F.array(value), then), F.lit(0))
    own = given(text, lambda v: F.when(F.length(v) >= 10, given(known(v), lambda f: given(ranked(f), winner))))
    return own


#: Slots of a profile: a prime, so that runs of letters spread over all of them.
SLOTS = 4093
#: Texts of known languages, for those that no labelled table covers. The first sentences are article 1 of the declaration of human rights.
SAMPLES = {
    "en": "All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience and should act towards one another in a spirit of brotherhood. "
    "Please wash your hands with soap before you cook or eat, and boil the water that you drink. The school will open again on Monday, and every child should bring a book and a pen. If there is a fire, "
    "leave the house at once and call for help. Farmers who plant early have a better harvest when the rains are short. You can register to vote at the office of your ward until the end of this month.",
    "sw": "Watu wote wamezaliwa huru, hadhi na haki zao ni sawa. Wote wamejaliwa akili na dhamiri, hivyo yapasa watendeane kindugu. "
    "Tafadhali osha mikono yako kwa sabuni kabla ya kupika au kula, na chemsha maji ya kunywa. Shule itafunguliwa tena siku ya Jumatatu, na kila mtoto alete kitabu na kalamu. Kukiwa na moto, "
    "ondoka nyumbani mara moja na uombe msaada. Wakulima wanaopanda mapema hupata mavuno mazuri wakati mvua ni chache. Unaweza kujiandikisha kupiga kura katika ofisi ya kata yako hadi mwisho wa mwezi huu.",
    "fr": "Tous les êtres humains naissent libres et égaux en dignité et en droits. Ils sont doués de raison et de conscience et doivent agir les uns envers les autres dans un esprit de fraternité. "
    "Veuillez vous laver les mains avec du savon avant de cuisiner ou de manger, et faites bouillir l'eau que vous buvez. L'école ouvrira de nouveau lundi, et chaque enfant doit apporter un livre et un stylo. En cas d'incendie, "
    "quittez la maison tout de suite et appelez à l'aide. Les paysans qui sèment tôt ont une meilleure récolte quand les pluies sont courtes. Vous pouvez vous inscrire pour voter au bureau de votre quartier jusqu'à la fin du mois.",
    "de": "Alle Menschen sind frei und gleich an Würde und Rechten geboren. Sie sind mit Vernunft und Gewissen begabt und sollen einander im Geist der Brüderlichkeit begegnen. "
    "Bitte waschen Sie sich die Hände mit Seife, bevor Sie kochen oder essen, und kochen Sie das Wasser ab, das Sie trinken. Die Schule öffnet am Montag wieder, und jedes Kind soll ein Buch und einen Stift mitbringen. Wenn es brennt, "
    "verlassen Sie sofort das Haus und rufen Sie um Hilfe. Bauern, die früh säen, haben eine bessere Ernte, wenn der Regen kurz ist. Bis zum Ende des Monats können Sie sich im Amt Ihres Bezirks für die Wahl eintragen.",
    "es": "Todos los seres humanos nacen libres e iguales en dignidad y derechos y, dotados como están de razón y conciencia, deben comportarse fraternalmente los unos con los otros. "
    "Por favor, lávese las manos con jabón antes de cocinar o comer, y hierva el agua que bebe. La escuela abrirá otra vez el lunes, y cada niño debe traer un libro y un lápiz. Si hay un incendio, "
    "salga de la casa enseguida y pida ayuda. Los campesinos que siembran temprano tienen una cosecha mejor cuando las lluvias son cortas. Puede inscribirse para votar en la oficina de su barrio hasta el fin de este mes.",
}


def letters(c: Column) -> Column:
    """The lower-case text where what is no letter counts as one space between words; profiles count each three of its characters in a row."""
    gap = r"(?![a-z])(?: (?=[^\p{L}])|[^\p{L} ])[^\p{L}]*+"  # one plain space is left as it is
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(c), gap, " ")), F.lit(" "))


#: Characters whose slots a task makes at a time.
STRETCH = 1 << 20


def _runs(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Stretches of texts: the place of each text, its number of slots, and the slots of all of them one after another. Nulls have none."""
    size = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    places = np.flatnonzero(size >= 3)
    size, texts = size[places], texts.take(pa.array(places)).cast(pa.large_string())
    stretch = np.cumsum(size) // STRETCH
    for first in np.unique(stretch, return_index=True)[1] if len(places) else ():
        last = first + np.searchsorted(stretch[first:], stretch[first], side="right")
        _, ends, data = (part := texts.slice(first, last - first)).buffers()
        ends = np.frombuffer(ends, dtype=np.int64)[part.offset : part.offset + len(part) + 1]
        code = np.frombuffer(data[int(ends[0]) : int(ends[-1])].to_pybytes().decode().encode("utf-32-le"), dtype=np.uint32)
        code = _modulo(code).astype(np.int32)
        slot = _modulo(code[:-2] * (7919 % SLOTS) + code[1:-1] * 241 + code[2:])
        own = np.ones(len(code), dtype=bool)  # the last two characters of a text begin no run
        end = np.cumsum(size[first:last])
        own[end - 1] = own[end - 2] = False
        yield places[first:last], size[first:last] - 2, slot[own[:-2]]


def _modulo(x: np.ndarray) -> np.ndarray:
    return x - x // SLOTS * SLOTS


@dataclass
class Profile:
    """A weight for each language and slot: a thousand times the logarithm of the slot's share in the language, a whole number so that sums do not depend on their order."""

    weights: dict[str, list[int]]

    def detect(self, c: Column) -> Column:
        """The language under which the text is likeliest; null for texts under ten characters, without letters, or where two languages are equally likely."""
        names = sorted(self.weights)
        table = [np.array(self.weights[k], dtype=np.int64) for k in names]

        def best(texts: pa.Array) -> pa.Array:
            won = np.full(len(texts), -1)
            for places, size, slot in _runs(texts):
                start = np.cumsum(size) - size
                sums = np.stack([np.add.reduceat(w[slot], start) for w in table])
                most = sums.max(axis=0)
                won[places] = np.where((sums == most).sum(axis=0) == 1, sums.argmax(axis=0), -1)
            return pa.DictionaryArray.from_arrays(pa.array(won, pa.int32(), mask=won < 0), pa.array(names, pa.string())).cast(pa.string())

        @F.arrow_udf("string")
        def likeliest(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for x in texts:
                yield best(x)

        text = normalize(c)
        return likeliest(F.when(F.length(text) >= 10, letters(text)))


def learn(texts: DataFrame, languages: Sequence[str], text: str = "text", lang: str = "lang") -> Profile:
    """Profiles of the languages named, from all rows that are labelled with one of them.

    Tasks count the slots of their batches, and what comes to the driver is a count for each language and slot, SLOTS of them for a language at most.
    """
    own = texts.where(F.col(lang).isin(*languages)).select(F.col(lang).alias("lang"), letters(normalize(F.col(text))).alias("text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {}
        for b in batches:
            for k in pc.unique(b.column("lang")).to_pylist():
                n = total.setdefault(k, np.zeros(SLOTS, dtype=np.int64))
                for _, _, slot in _runs(b.column("text").filter(pc.equal(b.column("lang"), k))):
                    n += np.bincount(slot, minlength=SLOTS)
        for k, n in total.items():
            there = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(there), pa.string()), pa.array(there, pa.int32()), pa.array(n[there])], names=["lang", "slot", "n"])

    counts = own.mapInArrow(counted, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    found = {(r.lang, r.slot): r.n for r in counts.collect()}
    total = {k: sum(n for (x, _), n in found.items() if x == k) for k in languages}
    return Profile({k: [round(1000 * math.log((found.get((k, s), 0) + 0.5) / (total[k] + 0.5 * SLOTS))) for s in range(SLOTS)] for k in languages})


def learned(spark: SparkSession, labelled: DataFrame | None = None, languages: Sequence[str] = tuple(SAMPLES)) -> Callable[[Column], Column]:
    """A detector for the languages, from the labelled texts (text, lang) and, for languages that they lack, from the samples."""
    there = {r.lang for r in labelled.where(F.col("lang").isin(*languages)).select("lang").distinct().collect()} if labelled is not None else set()
    texts = spark.createDataFrame([(SAMPLES[k], k) for k in languages if k not in there and k in SAMPLES], "text string, lang string")
    if labelled is not None:
        texts = texts.unionByName(labelled.select("text", "lang"))
    return learn(texts, languages).detect


def unknown(c: Column) -> Column:
    """A detector that knows nothing: every gate lets pass."""
    return F.lit(None).cast("string")
