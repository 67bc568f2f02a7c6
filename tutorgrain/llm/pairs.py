"""Defective prompt-response pairs, each with its one defect.

Copies are found by compressing every response with its own prompt as zstandard dictionary: what the prompt already
says costs next to nothing, so the bytes that remain measure what the response adds. An exact word comparison confirms.
Languages and refusals come from dictionaries, cut-off answers from the terminal context: the final words, and how often
answers that begin with the same words end there in the whole table.
"""

from __future__ import annotations

import re
import unicodedata
from difflib import SequenceMatcher

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tutorgrain.storage import materialize

# fixed values: mere stand-ins for an answer, in lower case and without surrounding brackets
STAND_INS = frozenset("null none nil nan n/a na tbd todo empty undefined blank missing".split()) | {"no response", "no answer", "no reply", "not available", "not applicable", "silence", "keine antwort", "sin respuesta", "pas de réponse", "response missing", "no output", "no text"}
# fixed values: frequent function words by language
FUNCTION_WORDS = {
    "en": "the a an of to in is are was were that this which what why how where when with for on by from it its you your my me i we they does do did be been has have had not but and or if so then would could should can will at as than there here their them once only both these those into out up because about",
    "de": "der die das ein eine einer eines einem einen und oder aber nicht ist sind war wie was warum wo wenn dann mit für auf von vom zu zum zur im am den dem des ich du er sie es wir ihr mir mich dir dich mein meine dein deine noch nur auch sich kann kannst muss müssen wird werden weil daraus vor nach bei über als dass hier diese dieser dieses aus bevor einmal zuerst ob fast",
    "fr": "le la les un une des du de et ou mais ne pas est sont était que qui quoi comment pourquoi où quand avec pour sur par dans ce cette ces cet il elle nous vous je tu mon ma mes ton ta tes son sa ses au aux en plus se si car donc puis entre ici dois peux alors avant encore faut après comme fois l d j c qu n t s seulement",
    "es": "el la los las un una unos unas de del y o pero no es son era que qué cómo por para con en sobre este esta estos estas eso ese lo le se mi mis tu tus su sus yo tengo tiene hay más ya si sí cuando donde dónde porque pues al entre aquí antes después puedes me te como tal solo sirven luego primero fue demasiado otra vez",
    "it": "il lo la gli le un una di del della e o ma non è sono che chi cosa come perché dove quando con per su da in questo questa io tu mio mia tuo più si se qui anche prima dopo puoi mi ti",
    "pt": "o a os as um uma de do da dos das e ou mas não é são que quem como por porque onde quando com para em no na este esta eu você meu minha seu sua mais se aqui também antes depois pode me",
    "nl": "de het een van en of maar niet is zijn was dat die wat waarom hoe waar wanneer met voor op door in dit deze ik jij je mijn jouw meer hier ook er aan naar kan moet wordt als dan nog",
}
# fixed values: how a refusal is worded, by language
REFUSALS = [
    r"\b(?:i|we)(?:'m| am| are)? (?:really |simply |afraid i )?(?:can'?t|cannot|can not|could not|couldn'?t|unable to|not able to|won'?t be able to|will not be able to|not allowed to|not permitted to|not in a position to|must decline to|have to decline to|decline to|refuse to|will not|won'?t|would rather not|'?d rather not|may not|prefer not to)\s+(?:\w+\s+){0,2}?(?:help|assist|answer|respond|reply|discuss|provide|work through|go into|take part|participate|explain|talk|speak|comment|engage|continue|share|support|address|tutor|cover|do that|do this)\b",
    r"\bi(?:'d| would) rather not\b", r"\b(?:do not|don'?t) have (?:the )?permission\b", r"\boff[ -]limits\b", r"\boutside (?:of )?what i(?:'m| am) (?:able|allowed|permitted)\b",
    r"\b(?:must|have to) decline\b", r"\bas an? (?:ai|language model|assistant)\b.{0,40}\b(?:cannot|can'?t|unable|not able|not allowed)\b", r"\bagainst (?:my|our|the) (?:guidelines|policy|policies|rules)\b",
    r"\bnicht (?:helfen|beantworten|antworten|weiterhelfen|besprechen|darüber (?:reden|sprechen))\b", r"\b(?:darf|kann|möchte|werde) ich (?:\w+\s+){0,4}nicht\b.{0,30}\b(?:helfen|beantworten|antworten|sagen|erklären|besprechen)\b",
    r"\bne (?:peux|suis) pas\b.{0,30}\b(?:aider|répondre|autorisée?|mesure|discuter)\b", r"\bpas le droit de\b", r"\bje (?:refuse|préfère ne pas|dois refuser)\b", r"\bt'aider\b.{0,20}\bimpossible\b",
    r"\bno (?:puedo|podré|me es posible|se me permite|tengo permiso|estoy autorizad[oa])\b.{0,40}\b(?:ayudar\w*|responder\w*|contestar\w*|hablar|para|a)\b", r"\bno se me permite\b", r"\bprefiero no\b",
]
_REFUSAL = re.compile("|".join(REFUSALS), re.I | re.S)
_WORD = re.compile(r"[^\W_]+")
_DANGLING = re.compile(r"(?:^|\s)(?:dr|prof|mr|mrs|ms|e\.g|i\.e|z\.b|d\.h|p\. ?ej|vs|cf|fig|no|nr|approx)\.$", re.I)
_DONE = re.compile(r"""(?:[.!?…。]["'”’»)\]*_`]*|:\)|;\)|[)\]}`»”"]|[^\w\s.,;:�'’(\[{<«„“/&+=*%#@^~|\\-])$""")
_RESULT = re.compile(r"(?:^|\s)(?:is|=|:|ist|es|est|equals|gives)\s+[-+]?\d+(?:[.,]\d+)?\s?%?$", re.I)
SCAN = "empty boolean, copies boolean, other boolean, refusal boolean, ragged boolean, shape string, words int, starts array<string>, added double"
SHAPE_WORDS = 6
_UNSEEN = frozenset(("Cf", "Cc", "Zs", "Zl", "Zp", "Cn", "Co"))
_INVISIBLE = "".join(chr(c) for c in (*range(33), 127, 0xA0, 0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF))


def visible(text: str | None) -> str:
    """The text without white space and invisible characters at its ends."""
    if not text:
        return ""
    text = text.strip(_INVISIBLE)
    if text and (unicodedata.category(text[0]) in _UNSEEN or unicodedata.category(text[-1]) in _UNSEEN):
        seen = [k for k, c in enumerate(text) if not (c.isspace() or unicodedata.category(c) in _UNSEEN)]
        return text[seen[0] : seen[-1] + 1] if seen else ""
    return text


def is_empty(answer: str) -> bool:
    bare = answer.strip("[](){}<>*_\"'` .!-–—…?/").lower()
    return not any(c.isalnum() for c in answer) and not _SMILE.search(answer) or bare in STAND_INS


_SMILE = re.compile(r"[:;]-?[)D]|[\U0001F300-\U0001FAFF✓✔]")
_BY_WORD: dict[str, list[str]] = {}
for _code, _words in FUNCTION_WORDS.items():
    for _w in _words.split():
        _BY_WORD.setdefault(_w, []).append(_code)


_VOTES = {w: [(code, 1.0 / len(codes)) for code in codes] for w, codes in _BY_WORD.items()}
# fixed values: letters and marks that only one of the languages uses
LETTERS = {"¿": "es", "¡": "es", "ñ": "es", "ß": "de", "œ": "fr", "ç": "fr", "ê": "fr", "ã": "pt", "õ": "pt"}


def language(text: str) -> str | None:
    """The language whose function words and own letters the text holds most, if it clearly leads; else None."""
    votes: dict[str, float] = {}
    for c, code in LETTERS.items():
        if c in text:
            votes[code] = votes.get(code, 0.0) + 1.5
    vote = _VOTES.get
    for w in _WORD.findall(text.lower()):
        for code, share in vote(w, ()):
            votes[code] = votes.get(code, 0.0) + share
    if not votes:
        return None
    ranked = sorted(votes.items(), key=lambda x: -x[1])
    first, second = ranked[0], ranked[1] if len(ranked) > 1 else ("", 0.0)
    return first[0] if first[1] >= 2 and first[1] >= 1.5 * second[1] else None


def added_share(prompt: str, answer: str) -> float:
    """Bytes the answer still takes with the prompt as dictionary, as a share of its own bytes."""
    p, a = " ".join(_WORD.findall(prompt.lower())).encode(), " ".join(_WORD.findall(answer.lower())).encode()
    if not p or not a:
        return 1.0
    if len(p) < 8:  # shorter dictionaries are not accepted
        return 0.0 if p == a else 1.0
    shared = zstandard.ZstdCompressionDict(p, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    options = zstandard.ZstdCompressionParameters.from_level(
        3, window_log=max(10, (len(p) + len(a)).bit_length()), format=zstandard.FORMAT_ZSTD1_MAGICLESS,
        write_content_size=False, write_checksum=False, write_dict_id=False,
    )
    packed = zstandard.ZstdCompressor(dict_data=shared, compression_params=options).compress(a)
    return max(0, len(packed) - 6) / len(a)


def only_copies(prompt: str, answer: str) -> bool:
    """Exact check: nearly all words of the answer stand in the prompt in order, and nearly all of the prompt is there."""
    p, a = _WORD.findall(prompt.lower()), _WORD.findall(answer.lower())
    if not p or not a:
        return False
    in_p, in_a = set(p), set(a)
    if sum(w not in in_p for w in a) > max(3, 0.15 * len(a)) or sum(w in in_a for w in p) < 0.7 * len(p):
        return False  # even in any order too much is new, or too little of the prompt is there
    kept, rest, fresh = set(), a, 0
    reach = 2 * len(p) + max(3, int(0.15 * len(a)))  # what begins behind more new words than may be is no copy
    while rest:  # the prompt may be given back more than once
        same = 0
        while rest[same : same + len(p)] == p:
            same += len(p)
        if same:
            kept.update(range(len(p)))
            rest = rest[same:]
            continue
        m = SequenceMatcher(None, p, rest[:reach], autojunk=False)
        found = [b for b in m.get_matching_blocks() if b.size]
        if not found or sum(b.size for b in found) < 0.5 * min(len(p), len(rest)):
            break
        kept.update(i for b in found for i in range(b.a, b.a + b.size))
        end = found[-1].b + found[-1].size
        fresh += end - sum(b.size for b in found)
        rest = rest[end:]
    fresh += len(rest)
    return len(kept) >= 0.7 * len(p) and fresh <= max(3, 0.15 * len(a))


def is_ragged(answer: str) -> bool:
    """The final words lack an end: no terminator, a broken character, a cut word or an abbreviation that dangles."""
    tail = answer[-40:]  # the patterns look at the last characters only
    if _DANGLING.search(tail):
        return True
    if answer.count("```") % 2:
        return True
    return not _DONE.search(tail)


def scan_pair(prompt: str | None, answer: str | None) -> tuple:
    a, p = visible(answer), visible(prompt)
    if is_empty(a):
        return (True, False, False, False, False, None, 0, [], 1.0)
    share = added_share(p, a)
    copies = share <= 0.6 and only_copies(p, a)
    refusal = not copies and bool(_REFUSAL.search(a.replace("’", "'")))
    other = False
    if not copies and not refusal:  # the first defect counts, so later ones need no look
        spoken = language(a)
        other = spoken is not None and language(p) not in (None, spoken)
    ragged = is_ragged(a) and not (_RESULT.search(a) and len(a.split()) <= 8)
    words = a.split(None, SHAPE_WORDS)
    count = len(words) if len(words) <= SHAPE_WORDS else SHAPE_WORDS + len(words[-1].split())
    tokens = re.sub(r"\d+(?:[.,]\d+)*", "#", " ".join(words[:SHAPE_WORDS]).lower()).split()
    starts = [" ".join(tokens[:k]) for k in range(1, len(tokens) + 1)]
    shape = starts[-1] if count <= SHAPE_WORDS else None
    return (False, copies, other, refusal, ragged, shape, count, starts, share)


def find_defects(df: DataFrame, pair_id: str, prompt: str, answer: str) -> DataFrame:
    """(pair_id, defect_type) of every defective pair: empty, copies_question, refusal, other_language or truncated.

    ``prompt`` and ``answer`` may be nested paths. A null answer (or null parent struct) is empty; a null prompt can
    neither be copied nor differ in language. A pair has one defect, the first in the order above. Short answers
    without a terminator count as finished if they state a result or are idioms: they end there after three different
    prompts at least, no more answers go on than end there, within the last word or behind it, and that word stands
    whole in other answers or the prompts are many (twenty and a thousandth of all pairs). One or two words count as
    finished unless three answers and more than end there go on. Equal pairs count once as evidence, whatever their
    ids; repeated pairs are judged each by itself; an empty table gives no rows.
    """

    @F.pandas_udf(SCAN)
    def scan(prompts: pd.Series, answers: pd.Series) -> pd.DataFrame:
        names = [x.split()[0] for x in SCAN.split(", ")]
        return pd.DataFrame([scan_pair(p, a) for p, a in zip(prompts, answers)], columns=names)

    keys = F.xxhash64(F.col(prompt)).alias("asked"), F.xxhash64(F.col(prompt), F.lit(" "), F.col(answer)).alias("pair")
    rows = df.select(F.col(pair_id).alias("id"), *keys, scan(F.col(prompt), F.col(answer)).alias("x")).select("id", "asked", "pair", "x.*")
    rows = materialize(rows, "pair-scan")
    # only short ragged answers need the lookup; the others share the null shape and must not meet in a join
    short, others = F.col("shape").isNotNull() & F.col("ragged"), F.lit(False)
    judged = rows.where(short).join(_endings(df, rows, answer), "shape", "left").unionByName(rows.where(~short).withColumns({"idiom": others, "goes_on": others}).drop("starts"), allowMissingColumns=True)
    finished = F.coalesce("idiom", F.lit(False)) | ((F.col("words") <= 2) & ~F.col("shape").rlike("[-�]$") & ~F.coalesce("goes_on", F.lit(False)))
    defect = (
        F.when(F.col("empty"), "empty")
        .when(F.col("copies"), "copies_question")
        .when(F.col("refusal"), "refusal")
        .when(F.col("other"), "other_language")
        .when(F.col("ragged") & ~F.coalesce(finished, F.lit(False)), "truncated")
    )
    return judged.select(F.col("id").alias(pair_id), defect.alias("defect_type")).where("defect_type IS NOT NULL")


def _endings(df: DataFrame, rows: DataFrame, answer: str) -> DataFrame:
    """(shape, idiom, goes_on): terminal context of every short ragged ending, from distinct pairs; counts combine map-side."""
    pairs = rows.where(~F.col("empty")).groupBy("pair").agg(*[F.first(c).alias(c) for c in ("asked", "starts", "shape", "ragged")])
    head, last = F.regexp_extract("shape", r"^(.*?)\S*$", 1), F.regexp_extract("shape", r"(\S*)$", 1)
    starts = pairs.select(F.explode("starts").alias("shape")).groupBy("shape").agg(F.count(F.lit(1)).alias("n")).select(head.alias("head"), last.alias("word"), "n")
    ends = pairs.where("shape IS NOT NULL AND ragged").groupBy("shape").agg(F.count(F.lit(1)).alias("ended"), F.countDistinct("asked").alias("prompts")).withColumns({"head": head, "cut": last})
    # the same words, or a longer last word: what an answer that is cut inside a word shares with whole ones
    inside = F.substr("word", F.length("cut") + 1, F.lit(1)).rlike(r"^[\p{L}\p{N}]")
    begun = ends.join(starts, "head").where((F.col("word") == F.col("cut")) | (F.startswith("word", F.col("cut")) & inside)).groupBy("shape").agg(F.sum("n").alias("begun"))
    found = ends.join(begun, "shape").crossJoin(F.broadcast(pairs.agg(F.count(F.lit(1)).alias("pairs"))))  # one row
    found = found.withColumn("w", F.regexp_extract("shape", r"([\p{L}\p{N}#]+)[^\p{L}\p{N}#]*$", 1)).withColumn("stays", 2 * F.col("ended") >= F.col("begun"))
    # words that another character follows are whole
    words = F.split(F.lower(F.col(answer)), r"[^\p{L}\p{N}]+")
    whole = df.select(F.explode(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0)))).alias("w")).distinct()
    asked = found.where("stays AND prompts >= 3").select("w").distinct()
    known = whole.join(asked, "w", "left_semi").withColumn("known", F.lit(True))
    many = (F.col("prompts") >= 20) & (1000 * F.col("prompts") >= F.col("pairs"))
    sure = F.coalesce("known", F.lit(False)) | (F.col("w") == "#") | many
    return found.join(known, "w", "left").select("shape", (F.col("stays") & (F.col("prompts") >= 3) & sure).alias("idiom"), (~F.col("stays") & (F.col("begun") - F.col("ended") >= 3)).alias("goes_on"))
