"""Column functions over dialogue text; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values -------------------------------------------------------------------------------------------------
STUDENT_LABELS = ["student", "s", "learner", "user", "human"]
TUTOR_LABELS = ["tutor", "t", "teacher", "assistant", "ai", "model"]
SHORT_ACKS = ["ok", "okay", "yes", "yeah", "yep", "no", "nope", "thanks", "thank you", "got it", "cool", "fine", "alright", "right"]
GREETINGS = ["hi", "hello", "hey", "good morning", "good evening"]
DISCOURSE_PHRASES = ["you know", "i mean", "sort of", "kind of", "let me think", "wait", "hold on"]
FILLER_WORDS = ["um", "uh", "erm", "hmm", "hm", "ah", "oh", "yeah", "yep", "yes", "nope", "okay", "ok", "right", "actually", "basically", "literally", "just", "maybe", "please", "thanks", "thank", "cool", "fine"]
FUNCTION_WORDS = "a an and are as at be been being but by can could did do does doing for from had has have having he her hers him his how i if in into is it its me my of on or our ours out over per she should so such than that the their theirs them then there these they this those through to too under was we were what when where which while who why will with within without would you your yours".split()
PEDAGOGY_WORDS = "answer ask basic basics case cases concept course definition example exercise explain important learn lesson method methods part parts problem problems question sheet step student teacher topic tutor understand".split()
NUMBER_WORDS = "zero one two three four five six seven eight nine ten first second third fourth fifth single double triple".split()
RETRIEVAL_STOPWORDS = FUNCTION_WORDS + "yes no ok okay right actually basically just maybe please thanks thank exercise exercises question questions answer answers source material materials example examples task tasks problem problems sheet sheets".split()
STUDENT_STYLES = {
    "student_clarification_question": ["?"],
    "student_confusion": ["i am confused", "i'm confused", "i do not get", "i don't get", "i got stuck", "i am stuck"],
    "student_partial_understanding": ["i think", "my instinct", "so ", "i used", "i guess"],
    "student_incorrect_attempt": ["right?", "so ", "means i can always", "is it simply"],
    "anaphora_ellipsis": ["that", "this", "it works", "it fail", "same step", "previous idea"],
}
TUTOR_STYLES = {
    "socratic_questioning": ["what do you think", "which part", "before i tell you", "why do you think", "how would you"],
    "hint_scaffolding": ["hint", "try focusing", "focus on", "useful hint", "next step"],
    "worked_example": ["for example", "worked example", "tiny example", "start with a tiny example"],
    "step_by_step_procedure": ["step by step", "safe procedure", "first", "second", "third"],
    "misconception_correction": ["not always", "important correction", "depends on the conditions", "wrong conclusion", "not quite"],
    "analogy_bridge": ["think of it like", "analogy", "bridge", "imagine", "like organising"],
    "comparison_contrast": ["contrast", "different from", "different questions", "compare", "versus"],
    "confirmation_feedback": ["yes, that is the right direction", "exactly", "correct", "good."],
    "metacognitive_prompt": ["pause and explain your reasoning", "reflect", "check whether that assumption fits"],
    "recap_synthesis": ["big picture", "recap", "summary", "fit together"],
    "prerequisite_remediation": ["prerequisite", "foundation", "depends on that earlier relationship", "repair the prerequisite"],
    "anaphora_setup": ["keep that in mind", "active concept for the next question", "go back to"],
    "anaphora_ellipsis": ["that", "this", "it works", "previous idea", "same step", "those assumptions"],
    "multi_kc_transition": ["reasoning shifts toward", "transition", "connect", "move from"],
}
EXPLANATION_CUES = [" is ", " means ", "the target idea", "i will explain"]
META_CUES = ["feel like a conversation", "real human student", "respond like an? llm tutor", "like an? llm tutor", "dialogue setup", "uploaded exercise", "teach me instead of", "messy questions", "refer back to earlier things", "diagnose your confusion", "the data mining content itself", "this to feel like", "i will respond like", "i may ask messy"]
RECAP_CUES = ["bring.{0,20}(it all|everything|all of it) together", "putting it all together", "(let'?s |to |)recap (everything|all|what we'?ve|all we'?ve)", "to sum (it|everything) up", "looking back at (everything|what we'?ve|all (that|the))", "we'?ve (now )?covered (everything|all|a lot|quite a bit|all (the|these))", "across all (the )?(exercises|topics|sections|concepts|examples|material)", "connect(ing)?.{0,20}(all (the|these)|everything)", "overall (summary|recap|picture|view) of", "throughout (this|our) (session|conversation|discussion|dialogue)", "general (strategy|approach|method|framework).{0,30}(all|any|every)", "applies (to all|across|regardless)", r"\bfinal strategy\b", r"\bidentify the task type\b"]
SELF_CORRECTION = r"\boh,?\s*wait\b|\bwait[,.]|\bactually,?\s*i\b|\bi mean\b|\bscratch that\b|\bsorry,?\s*i meant\b|\blet me redo\b|\bi made a mistake\b|\bcorrection:\b|\boh!?\s*(?:it|i)\s*should\b|\bhold on\b|\bwait,?\s*that'?s wrong\b"
CORRECTION = r"\bactually\b|\bnot quite\b|\bnot correct\b|\bthat'?s not right\b|\bshould be\b|\brather than\b|\binstead of\b|\bclose,?\s*but\b|\balmost,?\s*but\b|\bsmall (?:mistake|correction|issue)\b|\bthe issue is\b|\byou need to\b|^\s*no[,.]|\bincorrect\b|\bthat'?s a common (?:mistake|error)\b"
CONFIRMATION = r"\bexactly\b|\bthat'?s right\b|\bthat'?s correct\b|\bperfect\b|\bwell done\b|\bgood job\b|\byou got it\b|\bspot on\b|\bprecisely\b|\bthat'?s it\b|^\s*yes[,.!]?\s*$|^\s*yes,"
PURE_QUESTION = r"^\s*(?:what|how|why|when|where|which)\b.*\?\s*$|^\s*(?:can|could)\s+you\b.*\?\s*$|\bi don'?t understand\b|\bi'?m confused\b|\bhelp me understand\b|^\s*explain\b"
CLAIM_MARKER = r"[=<>]|\d|\bi think\b|\bi believe\b|\bso\b|\bthen\b"
CONFIRMATION_CHARS, ASSERTION_CHARS = 140, 15
# ---- end of fixed values ------------------------------------------------------------------------------------------

_EDGE = r"^[\s\x{00A0}]+|[\s\x{00A0}]+$"


def canonical_speaker(label: Column) -> Column:
    """student, tutor, or unknown for every other, blank or null label."""
    name = F.lower(F.trim(label))
    return F.when(name.isin(STUDENT_LABELS), "student").when(name.isin(TUTOR_LABELS), "tutor").otherwise("unknown")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, _EDGE, "")


def normalize_text(text: Column) -> Column:
    """Line ends as LF, runs of blanks and tabs as one blank, at most one empty line, no white space at the ends.

    Most texts are normal already: a look at their bytes tells, and only the others meet the regular expressions.
    """
    t = F.coalesce(text, F.lit(""))
    odd = (t < "!") | t.startswith("\u00a0") | ~F.is_valid_utf8(t)
    for part in ("\r", "\t", "  ", "\n\n\n"):
        odd = odd | t.contains(part)
    for end in (" ", "\n", "\x0b", "\f", "\u00a0", "\u0085", "\u2028", "\u2029"):  # also those that $ lets follow
        odd = odd | t.endswith(end)
    out = F.regexp_replace(t, "\r\n?", "\n")
    return F.when((t != "") & odd, strip(F.regexp_replace(F.regexp_replace(out, "[ \t]+", " "), "\n{3,}", "\n\n"))).otherwise(t)


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def noise_flags(text: Column) -> Column:
    """Array of flags of a normalised text; an empty text has only the first."""
    t = F.lower(text)
    short = (F.size(words(t)) <= 2) & ~t.rlike(r"[0-9]") & ~t.contains("?")
    some = F.array_compact(
        F.array(
            F.when(t.isin(SHORT_ACKS), "acknowledgement_only"),
            F.when(t.isin(GREETINGS), "greeting_only"),
            F.when(short, "low_content_short"),
        )
    )
    return F.when(t == "", F.array(F.lit("empty_or_near_empty"))).otherwise(some)


def contains_any(text: Column, phrases: list[str]) -> Column:
    found = F.lit(False)
    for p in phrases:
        found = found | text.contains(p)
    return found


def style_tags(speaker: Column, text: Column) -> Column:
    """Array of teaching-style tags in a fixed order; unknown speakers have none."""
    t = F.lower(F.coalesce(text, F.lit("")))
    student = F.array_compact(F.array(*[F.when(contains_any(t, p), F.lit(tag)) for tag, p in STUDENT_STYLES.items()]))
    tutor_marks = [
        F.when((t.contains("?") if tag == "socratic_questioning" else F.lit(True)) & contains_any(t, p), F.lit(tag))
        for tag, p in TUTOR_STYLES.items()
    ]
    tutor = F.array_compact(F.array(*tutor_marks))
    plain = F.when(contains_any(t, EXPLANATION_CUES), F.array(F.lit("direct_explanation"))).otherwise(tutor)
    none = F.array().cast("array<string>")
    return (
        F.when(speaker == "student", student)
        .when(speaker == "tutor", F.when(F.size(tutor) > 0, tutor).otherwise(plain))
        .otherwise(none)
    )


def preview(text: Column, limit: int = 120) -> Column:
    """One line of at most ``limit`` characters, shortened with three dots."""
    flat = strip(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    cut = F.concat(F.rtrim(F.substring(flat, 1, limit - 3)), F.lit("..."))
    return F.when(F.length(flat) <= limit, flat).otherwise(cut)


def light_tokens(text: Column) -> Column:
    """Tokens of the text without discourse phrases, technical forms in one piece."""
    out = F.concat(F.lit(" "), F.coalesce(text, F.lit("")), F.lit(" "))
    for phrase in DISCOURSE_PHRASES:
        out = F.regexp_replace(out, rf"(?i)\b{phrase}\b", " ")
    return F.regexp_extract_all(out, F.lit("[A-Za-z0-9]+(?:[-_/][A-Za-z0-9]+)?"), F.lit(0))


def without_fillers(tokens: Column) -> Column:
    """Tokens that are no filler words; numbers, capitals and joined forms always stay."""
    return F.filter(
        tokens,
        lambda w: ~F.lower(w).isin(FILLER_WORDS)
        | w.rlike("[0-9_/-]")
        | (w.rlike("[A-Z]") & ~w.rlike("[a-z]")),
    )


def match_normal(text: Column, split_slash: bool = False) -> Column:
    """Lower case, joined words split, everything but a-z and 0-9 as one blank."""
    joint = "[-_/]" if split_slash else "[-_]"
    t = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), f"([a-z]){joint}([a-z])", "$1 $2")
    return F.trim(F.regexp_replace(t, "[^a-z0-9]+", " "))


def content_tokens(text: Column) -> Column:
    """Tokens of at least two characters that are no function, number or pedagogy words."""
    drop = FUNCTION_WORDS + NUMBER_WORDS + PEDAGOGY_WORDS
    return F.filter(F.split(match_normal(text), " "), lambda w: (F.length(w) >= 2) & ~w.isin(drop))


def retrieval_tokens(text: Column) -> Column:
    """Tokens for fielded retrieval: at least two characters and no retrieval stop words."""
    return F.filter(F.split(match_normal(text, True), " "), lambda w: (F.length(w) >= 2) & ~w.isin(RETRIEVAL_STOPWORDS))


def ngrams(tokens: Column, low: int = 2, high: int = 4) -> Column:
    """Distinct n-grams of ``low`` to ``high`` tokens, in order of length and place.

    The tokens are bound once by an outer lambda; written into the inner one, they would be computed for every n-gram.
    """
    none = F.array().cast("array<string>")

    def of(t: Column, n: int) -> Column:
        count = F.size(t) - n + 1
        starts = F.sequence(F.lit(1), F.greatest(count, F.lit(1)))
        return F.when(count >= 1, F.transform(starts, lambda i: F.concat_ws(" ", F.slice(t, i, n)))).otherwise(none)

    def build(t: Column) -> Column:
        return F.array_distinct(F.flatten(F.array(*[of(t, n) for n in range(low, high + 1)])))

    return F.transform(F.array(tokens), build)[0]


def acronyms(text: Column) -> Column:
    """Upper-case forms of acronyms and formula-like tokens: all capitals, or a capital with a digit."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\b[A-Za-z][A-Za-z0-9]{1,8}\b"), F.lit(0))
    kept = F.filter(
        found,
        lambda w: (~w.rlike("[0-9a-z]")) | (w.rlike("[0-9]") & w.rlike("[A-Z]")),
    )
    return F.array_distinct(F.transform(kept, lambda w: F.upper(w)))


def gate(text: Column, flags: Column) -> Column:
    """Why an exchange carries no knowledge component: low_content, meta_framing, recap_synthesis, else null."""
    low = F.arrays_overlap(flags, F.array(*map(F.lit, ["empty_or_near_empty", "acknowledgement_only", "greeting_only", "low_content_short"])))
    t = F.lower(text)
    return (
        F.when(F.array_contains(flags, "empty_or_near_empty"), "low_content")
        .when(low & (F.size(words(text)) <= 8) & ~text.contains("?"), "low_content")
        .when((text != "") & t.rlike("|".join(META_CUES)), "meta_framing")
        .when((text != "") & t.rlike("|".join(RECAP_CUES)), "recap_synthesis")
    )
