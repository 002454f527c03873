"""Broken pairs of an original and its proposal.

A proposal is compressed with its original as a zstandard dictionary: a copy shrinks to almost nothing, a translation does not.
Dictionaries of function words and of refusals tell the language of a proposal and refusals. Truncation is told by a model of
the terminal context, learned from all pairs: how long proposals of an original's length are, by direction, and how often whole
and truncated ones lose the mark that the original ends with. A pair is truncated if that is the likelier way to its length and end.

Python sees each pair once, where it lies. What it returns holds no text, and only that is joined with jobs and issues.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.arrow import cut_lineage, map_batches

COPY = 0.46  # compressed size with the original to size without; translations stay above 0.5
MISSING = 0.25  # the part of the original that at least has no counterpart in a truncated proposal
CERTAIN = 10.0  # times that truncation must be the likelier way to the length and end of a pair
SMOOTH = 50  # pairs of its direction that a length's statistics are smoothed with

#: Function words of languages that proposals may come in. Fixed values.
FUNCTION_WORDS = {
    "en": "the of and to in is it that for on with as at by from this be are was or an not have has which you your when after before if will can its their there been than into until does never why no once per every most about some what",
    "de": "der die das und ist in den von zu mit sich des auf für nicht ein eine dem als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum wenn vor warum bevor bis zur kein keine ohne oder im unter gemäß wurde durch ihre einmal pro jeder alle meisten mehrere außerhalb",
    "fr": "le la les de des du et est un une en que qui dans pour pas au aux sur par ce cette il elle avec sont se ne plus son sa ses ou mais nous vous après avant pendant selon sous été à être leur sans aucun",
    "es": "el la los las de del y es un una en que por con para no se su al lo como más pero sus le ha sin sobre este entre cuando muy hasta desde durante según después antes ninguna todo también",
    "it": "il lo la gli le di del della dei delle e è un una in che per con non si su al da come più ma sono dopo prima durante secondo nel alla dalla sul questo anche senza tutti ogni",
    "pt": "o a os as de do da dos das e é um uma em que por com para não se no na ao mais mas como são após antes durante segundo pelo pela sem este também foi nos nas",
    "nl": "de het een en van is in op te dat met voor niet zijn aan er om ook als bij door naar uit deze dit wordt worden over geen na tijdens volgens wanneer moet heeft alle hun maar tot onder meteen",
    "sv": "och att det som en på är av för med den till inte har de ett om var men sig så efter före under enligt när vid utan ska från kan alla",
    "da": "og at det som en på er af for med den til ikke har de et om var men sig så efter før under ifølge når ved uden skal fra kan alle",
    "no": "og at det som en på er av for med den til ikke har de et om var men seg så etter før under ifølge når ved uten skal fra kan alle",
    "pl": "i w na z się nie jest do że to o jak po dla od przez za być są ale lub oraz przed podczas według gdy bez wszystkie ten ta przy",
    "cs": "a v na se je že s z do o to jako po pro od za být jsou ale nebo před podle když bez všechny ten při není",
    "fi": "ja on ei se että oli ovat mutta kun niin myös jälkeen ennen aikana mukaan ilman kaikki tämä joka sekä tai",
    "hu": "a az és egy hogy nem is van de meg után előtt alatt szerint ha minden ez vagy volt még nélkül",
    "tr": "ve bir bu için ile de da çok daha sonra önce göre kadar her değil olarak olan ancak veya gibi",
    "ro": "și în de la cu pe nu este un o care pentru din să după înainte timpul fără toate sau dar sunt prin",
}
#: Words of a refusal by language: who speaks, what declines, and what is declined or why. A star stands
#: for any ending, a low line for a gap of at most one word. Fixed values.
REFUSAL = {
    "en": (
        "i i'm i’m i'd i’d we we're we’re me us my our assistant model ai",
        "can't can’t cannot can_not couldn't won't won’t will_not unable not_able not_allowed not_permitted not_possible not_going_to rather_not must_not don't_feel_comfortable declin* refus* withh* blocked no_translation against violat* breaks outside_what outside_of_what outside_my outside_our falls_outside lies_outside conflict*",
        "translat* render* request* passage* text* content* help* assist* provid* comply* process* answer* guideline* polic* rule* instruction* principle*",
    ),
    "de": (
        "ich wir mir uns mein* unser* assistent* sprachassistent* sprachmodell* ki ki-*",
        "nicht kein keine keinen ablehn* abgelehnt lehne lehnen verweiger* verzicht* widerspr* verstößt verstoßen liegt_außerhalb außerhalb_dessen außerhalb_mein* außerhalb_unser* absehen",
        "übersetz* anfrage* bitte text* inhalt* abschnitt* hilf* helf* weiterhelf* unterstütz* bearbeit* verarbeit* wiedergeb* wiederzugeben nachkommen richtlinie* vorgabe* regel* grundsätz* antwort*",
    ),
    "fr": ("je nous moi mon mes notre nos assistant modèle", "ne_peux ne_puis ne_suis_pas ne_pouvons refus* déclin* impossible", "tradu* aid* répond* demande* texte* contenu* passage* règle* directive*"),
    "es": ("yo me mi mis nosotros nuestr* asistente modelo", "no_puedo no_podemos no_es_posible rechaz* declin* neg*", "traduc* ayud* solicitud* petición texto* contenido* norma* política*"),
    "nl": ("ik wij we mij ons mijn onze assistent model", "kan_niet kan_geen mag_niet niet_mogelijk weiger* afwijz* geen", "vertal* help* helpen verzoek* tekst* inhoud* passage* richtlijn* regel*"),
}
#: Notes that stand in place of a text. Fixed values.
NOTES = re.compile(
    r"^\W*(?:no|empty|missing|kein|keine|leer|fehlt|none|null|nil|nan|n\W?a|tbd|todo|to do|tba|wip|pending|untranslated|not translated|unübersetzt|nicht übersetzt|(?:translation|übersetzung) (?:missing|pending|fehlt|folgt|follows|here|hier)"
    r"|(?:no|kein|keine|empty|leer\w*|missing|fehlend\w*) (?:output|text|translation|übersetzung|ausgabe|inhalt|content|response|result|antwort|ergebnis|string|proposal|vorschlag)(?: \w+)?|blank|placeholder|platzhalter|error|fehler|undefined|lorem ipsum)\W*$",
    re.I,
)
WORDS = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
TAGS = re.compile(r"<[^<>]*>|&\w+;|&#\d+;")
SQUEEZE = re.compile(r"\W+")
END = re.compile(r"[.!?…:;。！？][\"'”“’‘»)\]*_~`]*\s*$")
CUT = re.compile(r"(?:…|\.\.\.|\[…\]|\[\.\.\.\]|,|-|–)\s*$")
VOWEL = re.compile(r"[aeiouyäöüéèêàáíóúœøåæаеёиоуыэюя]", re.I)
LATIN = re.compile(r"[A-Za-zÀ-ɏ]")
OTHER = re.compile(r"[Ͱ-῿⺀-\ud7ff]")


def _by_word() -> dict[str, list[tuple[str, float]]]:
    out: dict[str, list] = {}
    for lang, words in FUNCTION_WORDS.items():
        for w in set(words.split()):
            out.setdefault(w, []).append(lang)
    return {w: [(lang, 1 / len(langs)) for lang in langs] for w, langs in out.items()}


BY_WORD = _by_word()


def _words(listed: str) -> re.Pattern:
    one = lambda w: re.escape(w).replace(r"\*", r"\w*").replace("_", r"\s+(?:\w+\s+)?")
    return re.compile(r"(?<!\w)(?:" + "|".join(one(w) for w in sorted(listed.split(), key=len, reverse=True)) + r")(?!\w)")


DECLINING = [tuple(map(_words, lists)) for lists in REFUSAL.values()]
SENTENCE_END = re.compile(r"(?<=[.!?…])\s+")


def declines(text: str) -> bool:
    """Whether a sentence has a word of declining, and beside it a thing that is declined with someone who does, or two such things."""
    low = text.lower()
    for actors, refusing, objects in DECLINING:
        if refusing.search(low):
            for sentence in SENTENCE_END.split(low):
                if refusing.search(sentence) and (things := set(objects.findall(sentence))) and (len(things) > 1 or actors.search(sentence)):
                    return True
    return False


def natural(text: str) -> bool:
    """Whether a text has a word of natural language, and is not just codes, measures or one unbroken string."""
    tokens = (TAGS.sub(" ", text) if "<" in text or "&" in text else text).split()
    if not tokens:
        return False
    capital = 0
    for before, token in zip([None, *tokens], tokens):
        word = token.strip("\"'“”„‚‘’«»()[]{}.,;:!?…*_~`#|>=-+")
        if len(word) < 3 or len(word) > 45 or not WORDS.fullmatch(word):
            continue
        if before and before[-1].isdigit() and len(word) <= 4:  # a unit
            continue
        if OTHER.search(word):
            return True
        if not VOWEL.search(word):
            continue
        if not word.isupper():
            return True
        capital += 1
    return capital >= 2


def languages(words: list[str]) -> dict[str, float]:
    """How many function words of each language are among words in small letters; a word of several languages counts in part."""
    votes: dict[str, float] = {}
    for w in words:
        if w in BY_WORD:
            for lang, share in BY_WORD[w]:
                votes[lang] = votes.get(lang, 0.0) + share
    return votes


def shrinks_to(original: str, proposal: str) -> float:
    """The compressed size of the proposal with the original as dictionary, to its size without; punctuation and case are ignored.

    Texts too short for a dictionary shrink to 0 if they are equal, else not at all.
    """
    a, b = SQUEEZE.sub(" ", original.lower()).strip().encode(), SQUEEZE.sub(" ", proposal.lower()).strip().encode()
    if a == b:
        return 0.0
    if len(a) < 16 or len(b) < 16:
        return 1.0
    zd = zstandard.ZstdCompressionDict(a, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return len(zstandard.ZstdCompressor(level=3, dict_data=zd).compress(b)) / len(ALONE.compress(b))


ALONE = zstandard.ZstdCompressor(level=3)


def is_copy(original: str, proposal: str) -> bool:
    """Whether a proposal gives back its original, which must have words; additions are seen through by compressing the original with the proposal."""
    ratio = shrinks_to(original, proposal)
    if ratio < COPY:
        return True
    return len(proposal) > 1.25 * len(original) and len(original) >= 24 and shrinks_to(proposal, original) < COPY


#: Languages that a proposal can be told to be not in, in the order of the bits of ``wrong``.
TARGETS = tuple(FUNCTION_WORDS)


def not_in(bare: str, low: list[str]) -> int:
    """A bit for each of TARGETS that a proposal is not written in."""
    if not bare.isascii() and OTHER.search(bare) and len(OTHER.findall(bare)) > len(LATIN.findall(bare)):
        return (1 << len(TARGETS)) - 1
    votes = languages(low)
    top = sorted(votes.items(), key=lambda v: -v[1])[:2]
    if not top or top[0][1] < 1.5:
        return 0
    out = 0
    for k, target in enumerate(TARGETS):
        best = max((v for lang, v in top if lang != target), default=0.0)
        out |= (best >= 1.5 and best > 1.6 * votes.get(target, 0.0) + 0.4) << k
    return out


def looked_at(original: str | None, proposal: str | None) -> tuple[str | None, int, int, int, bool]:
    """(a defect that the pair alone shows, bits of the languages it is not in, lengths of original and proposal, whether its end was lost).

    Without a word of natural language in the original only emptiness and refusals can be told, and the length is 0.
    """
    original, proposal = original or "", (proposal or "").replace("\ufeff", "").replace("\u200b", "").strip()
    if not proposal:
        return "empty", 0, 0, 0, False
    bare = TAGS.sub(" ", proposal) if "<" in proposal or "&" in proposal else proposal
    words = WORDS.findall(bare)
    has_words = natural(original)
    if has_words and (not words or NOTES.match(bare) and not NOTES.match(original.strip())):
        return "empty", 0, 0, 0, False
    if not has_words and original.strip() and not re.search(r"\w", proposal) and re.search(r"\w", original):
        return "empty", 0, 0, 0, False
    if has_words and is_copy(original, proposal):
        return "copied", 0, 0, 0, False
    low = [w.lower() for w in words]
    if declines(proposal) and not declines(original):
        return "refusal", 0, 0, 0, False
    if not has_words:
        return None, 0, 0, 0, False
    lost = bool(END.search(original)) and not END.search(proposal) or bool(CUT.search(proposal)) and not CUT.search(original.strip())
    return None, not_in(bare, low), len(original.strip()), len(proposal), lost


def terminal_contexts(pairs: DataFrame) -> DataFrame:
    """The model of whole and truncated proposals: a row for each target language and length (in powers of two) of the originals.

    ``pairs`` are ``(target_lang, left, got, lost)``. Whole proposals have a logarithm of the ratio of lengths that is normal, around
    ``usual`` and within ``spread``, estimated from the median and lower and middle quantiles and smoothed with their language; truncated
    ones are spread evenly. What lies far below the normal counts for how often there are truncated ones (``rare``) and how often they
    lose their end (``cut_lost``), and what lies above the median for how often whole ones do (``whole_lost``).
    """
    spark = pairs.sparkSession
    ratio = F.log(F.col("got") / F.col("left"))
    known = pairs.where("left > 0 and got > 0").select(F.coalesce("target_lang", F.lit("")).alias("lang"), _size().alias("size"), ratio.alias("ratio"), "lost")
    quantiles = known.groupBy("lang", "size").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("ratio", [0.1, 0.25, 0.5, 0.75], 1_000).alias("q")).collect()  # languages x powers of two
    rows = []
    for lang in {r.lang for r in quantiles}:
        mine = [(r["size"], r.n, r.q[2], max((r.q[3] - r.q[1]) / 1.349, (r.q[2] - r.q[0]) / 1.2816)) for r in quantiles if r.lang == lang]
        n = sum(m[1] for m in mine)
        usual, spread = sum(m[1] * m[2] for m in mine) / n, math.sqrt(sum(m[1] * m[3] ** 2 for m in mine) / n)
        for size, k, u, s in mine:
            rows.append((lang, size, (k * u + SMOOTH * usual) / (k + SMOOTH), max(0.02, math.sqrt((k * s * s + SMOOTH * spread**2) / (k + SMOOTH)))))
    normal = F.broadcast(spark.createDataFrame(rows, "lang string, size int, usual double, spread double"))
    far, upper = F.col("ratio") < F.col("usual") - 5 * F.col("spread"), F.col("ratio") >= F.col("usual")
    smooth = lambda part, all_: (part + 0.5) / (all_ + 1)
    ends = known.join(normal, ["lang", "size"]).groupBy("lang").agg(
        smooth(F.count_if(far), F.count(F.lit(1))).alias("rare"), smooth(F.count_if(far & F.col("lost")), F.count_if(far)).alias("cut_lost"),
        smooth(F.count_if(upper & F.col("lost")), F.count_if(upper)).alias("whole_lost"),
    ).collect()  # a row a language
    by = {r.lang: r for r in ends}
    columns = "lang string, size int, usual double, spread double, rare double, cut_lost double, whole_lost double"
    return spark.createDataFrame([(*r, by[r[0]].rare, by[r[0]].cut_lost, by[r[0]].whole_lost) for r in rows], columns)


def _size():
    return F.floor(F.log2("left")).cast("int")


def _truncated():
    """Whether to be truncated is by far the likelier way to a pair's ratio of lengths and end."""
    beyond = F.log(F.col("got") / F.col("left")) - F.col("usual")
    end = lambda p: F.log(F.when(F.col("lost"), F.col(p)).otherwise(1 - F.col(p)))
    cut = F.log("rare") + beyond - math.log(1 - MISSING) + end("cut_lost")
    whole = F.log(1 - F.col("rare")) - F.log(F.col("spread") * math.sqrt(2 * math.pi)) - F.pow(beyond / F.col("spread"), 2) / 2 + end("whole_lost")
    return F.coalesce((beyond < math.log(1 - MISSING)) & (cut > whole + math.log(CERTAIN)), F.lit(False))


def defects(blocks: DataFrame, jobs: DataFrame, issues: DataFrame) -> DataFrame:
    """``(block_key, defect)`` of the defective ``(block_key, job_id, id, original, proposal)``.

    ``jobs`` gives ``(job_id, target_lang)`` and ``issues`` the ``(job_id, id)`` whose original was retained; both are made distinct. A
    null or blank proposal is ``empty`` whatever the original; a null original counts as one without words; blocks without a job
    or a target language are in no wrong one. A block that was delivered twice comes out once. Extra columns are ignored.

    The rows that meet jobs hold no text, so a job with a third of all blocks is a partition that AQE splits; what is defective
    is about a tenth, and only that meets the issues and is made distinct.
    """

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            found = [looked_at(o, p) for o, p in zip(batch.column("original").to_pylist(), batch.column("proposal").to_pylist())]
            return {k: batch.column(k) for k in ("block_key", "job_id", "id")} | {k: [f[i] for f in found] for i, k in enumerate(("shown", "wrong", "left", "got", "lost"))}

        return work

    seen = map_batches(
        blocks.select("block_key", "job_id", "id", "original", "proposal"), "block_key long, job_id string, id string, shown string, wrong int, left int, got int, lost boolean", make
    )
    jobs = jobs.where("job_id is not null").groupBy("job_id").agg(F.min("target_lang").alias("target_lang"))
    known = cut_lineage(seen.join(jobs, "job_id", "left"))
    bit = F.create_map(*(F.lit(x) for k, t in enumerate(TARGETS) for x in (t, 1 << k)))
    model = F.broadcast(terminal_contexts(known).withColumnRenamed("lang", "_lang").withColumnRenamed("size", "_size"))  # languages x powers of two
    judged = known.join(model, (F.coalesce("target_lang", F.lit("")) == F.col("_lang")) & (_size() == F.col("_size")), "left").select(
        "block_key", "job_id", "id",
        F.when(F.col("shown").isNotNull(), F.col("shown")).when(F.col("wrong").bitwiseAND(bit[F.col("target_lang")]) != 0, "wrong_language")
        .when((F.col("left") > 0) & _truncated(), "truncated").alias("defect"),
    ).where("defect is not null").dropDuplicates(["block_key"])
    kept = issues.select("job_id", "id").distinct().withColumn("kept", F.lit("retained"))
    retained = F.when(F.col("defect") == "copied", F.coalesce("kept", "defect")).otherwise(F.col("defect"))
    return judged.join(kept, ["job_id", "id"], "left").select("block_key", retained.alias("defect"))
