"""Prompt and response pairs that hold no usable answer, each with the kind of its defect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askmill.llm import minhash
from askmill.tables import cut

#: Words of an answer's opening, and unrelated prompts in which a template must recur.
OPENING = 12
RECURS = 2
#: Unrelated prompts in which a template without a listed phrase must recur, and its least words.
UNLISTED = 3
BARE_WORDS = 5
#: What stands for no answer at all.
PLACEHOLDERS = ("na", "none", "null", "nan", "nil", "tbd", "todo", "noanswer", "unknown", "empty", "blank", "answer", "finalanswer")
#: Phrases by which an answer is declined or said to be impossible, by language.
REFUSAL = "|".join(
    (
        r"\b(?:can ?not|can ?t|could ?n[o ]*t|unable to|not able to|won ?t|will not|not possible to|would not be appropriate|not comfortable)\b"
        r".*\b(?:answer|help|comment|respond|reply|say|assist|determine|determined|provide|given?|tell|discuss|share)\b",
        r"\b(?:decline|refuse|rather not|not allowed)\b",
        r"\bi (?:do not|don ?t) know\b|\bno (?:reply|answer|response) (?:can|could|is|will)\b|\bsorry but\b|\bi m sorry\b|\bi am sorry\b|\bi apologi",
        r"\b(?:insufficient|not enough|no) (?:evidence|information)\b|\b(?:do|does) not (?:contain|give|provide|hold|say|allow)\b|\b(?:not enough|insufficient|too little) (?:information|evidence|material|context)\b",
        r"\bcannot be (?:determined|answered|said|given|known)\b|\b(?:material|evidence|information|context) is insufficient\b|\bas an? (?:ai )?(?:language model|assistant)\b",
        r"\btut mir leid\b|\bleider\b|\bnicht (?:beantworten|sagen|helfen|bestimmen|feststell\w+|äußern|möglich|aus)\b|\breich(?:en|t) .*nicht\b|\bunzureichend\b|\bwei(?:ß|ss) (?:ich )?(?:es )?nicht\b|\bkeine (?:antwort|auskunft)\b",
        r"\bje regrette\b|\bdésolée?\b|\bne (?:peux|puis|sais|saurais) pas\b|\bimpossible (?:de|à) \w+\b|\bne permet(?:tent)? pas\b|"
        r"\b(?:préfère|souhaite|veux|désire) (?:ne )?pas\b|\bpréfère ne\b|\bne (?:suffi(?:t|sent)|souhaite|veux|peut) (?:pas|être)\b|\bpas en mesure\b|\b(?:preuves|éléments|informations|données) insuffisante?s\b",
        r"\blo siento\b|\blamento\b|\bno (?:puedo|sé|es posible)\b|\bno se puede\b|\bno (?:contiene|permite|basta)n?\b|\bprefiero no\b|"
        r"\bno (?:quiero|deseo|dispongo|estoy en condiciones)\b|\binsuficientes?\b|\bimposible (?:de )?\w+\b",
        r"\bmi dispiace\b|\bnon (?:posso|so|è possibile)\b|\bне могу\b|\bизвините\b|\bк сожалению\b|\bне знаю\b",
    )
)
#: Words of the closed classes (articles, prepositions, conjunctions, pronouns, auxiliaries, question words, yes and no) by language.
SMALL_WORDS = {
    "en": "the a an of in on at to for from by with under near as and or but not no yes is are was were be been has have had do does did can will would "
    "it its he she they them their this that these those there which what who whom whose when where how many one two both only all than",
    "de": "der die das den dem des ein eine einen einem einer von in im am an auf zu zum zur bei mit nach aus für unter nahe und oder aber nicht nein ja ist sind war waren "
    "wurde wurden hat hatte haben es er sie dies dieser diese dieses dazu davon darin welche welcher welches wer was wann wo wie viele beide beiden nur alle als",
    "fr": "le la les l un une des du de d à au aux en dans par pour avec sur sous près et ou mais ne pas non oui est sont était étaient fut furent a avait ont "
    "il elle ils elles se s ce c cette ces y qui que quel quelle quels quelles quand où comment combien deux tous seul plus",
    "es": "el la los las lo un una unos unas de del a al en por para con sobre bajo cerca y o pero no sí es son era eran fue fueron ha había han "
    "él ella ellos se este esta estos estas ese esa que qué quién cuál cuándo dónde cómo cuántos cuántas dos ambos más solo está están",
    "it": "il lo la i gli le un una uno di d del dello della dei degli delle a al allo alla in nel nello nella nell per con su vicino e o ma non no sì è sono era erano fu furono ha aveva "
    "egli essi questo questa si ne chi che quale quando dove come quanti due entrambi solo più",
    "pt": "o os as um uma uns umas de do da dos das a ao em no na nos nas por para com perto e ou mas não sim é são era eram foi foram há havia "
    "ele ela eles elas se isto este esta quem que qual quando onde como quantos dois ambos só mais",
    "nl": "de het een van in op te bij aan naar met voor door uit onder en of maar niet nee ja is zijn was waren werd werden heeft had "
    "hij zij dit dat deze die er wie wat welke wanneer waar hoe hoeveel twee beide alleen dan",
    "ru": "и или но не нет да в во на по из от до с со к у о об за под для рядом это этот эта эти был была было были есть он она оно они их его её ним ней них "
    "кто что какой какая какие когда где как сколько два двух две оба обе только",
}
#: Answers of one word that belong to one language.
YES_OR_NO = "oui non ja nein sí sì да нет"
#: A word that begins with a capital, a word in parentheses, a number; and what joins two of them to one name.
_NAME = r"\p{Lu}[\p{L}\p{M}\p{N}'’-]*|\(\p{L}+\)|\p{N}+"
_JOINED = r"(?<=#) (?:of|from|to|the|and|de|du|von|of the) (?=#)"


def plain(text: Column) -> Column:
    """Lower case, words parted by single spaces, nothing else."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}\p{N}]+", " "))


def parsed(predictions: DataFrame) -> DataFrame:
    """The parts of each output: (prediction_id, example_id, prompt, gold_answer, open_reasoning, has_line, answer)."""
    raw = F.coalesce("raw_output", "prediction", F.col("extraction.answer"))
    text = F.regexp_replace(raw, r"<\|[^|<>]*\|>", "")
    opened = F.regexp_replace(text, r"(?is)<think>.*?</think>", "")
    body = F.regexp_replace(opened, r"(?is)^.*</think>", "")
    line = r"(?is)^(?:.*\n)?[\s*_#>]*(?:final\s+)?(?:answer|antwort|réponse|respuesta)\s*[:：](.*)$"
    rows = predictions.select(
        "prediction_id", "example_id", "prompt", "gold_answer", F.lower(body).contains("<think>").alias("open_reasoning"), body.alias("body")
    ).withColumn("has_line", F.coalesce(F.col("body").rlike(line), F.lit(False)))
    answer = F.when(F.col("has_line"), F.regexp_extract("body", line, 1)).otherwise(F.col("body"))
    answer = F.regexp_replace(answer, r"(?s)\$?\\(?:boxed|text)\{(.*?)\}\$?", "$1")
    return rows.withColumn("answer", F.trim(F.regexp_replace(answer, r"[\s\p{Z}]+", " "))).drop("body")


def with_question(rows: DataFrame, gold: DataFrame) -> DataFrame:
    """Adds the question: the end of the prompt, or gold's under the example_id where the prompt is null."""
    asked = rows.where("prompt IS NOT NULL").withColumn("question", F.regexp_extract("prompt", r"(?s)^(?:.*\n)?\s*Question:\s*(.*)$", 1))
    known = gold.where("example_id IS NOT NULL").groupBy("example_id").agg(F.min("question").alias("question"))
    return asked.unionByName(rows.where("prompt IS NULL").join(known, "example_id", "left").select(*asked.columns))


def _among(words: Column, known: list[str]) -> Column:
    """How many of ``words`` are ``known``, repeated ones counted again."""
    return F.size(F.filter(words, lambda w: w.isin(*known)))


def language(words: Column) -> Column:
    """struct(n, own, language): the language with most small words among ``words``, and how many of these are in no other
    language's list; null if none has one, or two have as many of both."""
    lists = {k: v.split() for k, v in SMALL_WORDS.items()}
    scored = []
    for k, small in lists.items():
        own = sorted(set(small) - {w for other, ws in lists.items() if other != k for w in ws})
        scored.append(F.struct(_among(words, small).alias("n"), _among(words, own).alias("own"), F.lit(k).alias("language")))
    ranked = F.sort_array(F.array(*scored), asc=False)
    best, next_ = F.get(ranked, F.lit(0)), F.get(ranked, F.lit(1))
    return F.when((best.n > 0) & ((best.n > next_.n) | (best.own > next_.own)), best)


def templates(rows: DataFrame) -> DataFrame:
    """(opening, refuses): clusters of answer openings that decline.

    Names and numbers of an opening are masked, so that one template is the same text whatever it is asked
    about. Openings are clustered by their shingles (twelve words that differ within are too unlike to meet;
    a word more at an end joins). A cluster that recurs across ``UNLISTED`` unrelated prompts refuses if it has nothing
    to do with any of them: at least half of its rows are ``bare`` and none is ``supported`` by the gold answer. What that can't
    tell, since a refusal may name what it was asked about or be in another language than the question, phrases decide: a
    cluster that recurs across ``RECURS`` prompts refuses if at least half of its rows open with one, an opening
    that recurs nowhere if it does so itself.
    """
    counted = rows.groupBy("opening", F.xxhash64("question").alias("asked")).agg(
        F.count("*").alias("n"), F.count_if("bare").alias("bare"), F.max("supported").alias("supported")
    )
    counted = counted.groupBy("opening").agg(
        F.sum("n").alias("n"), F.count("*").alias("prompts"), F.sum("bare").alias("bare"), F.max("supported").alias("supported")
    )
    # the openings are read by the clustering and again by the vote; the outputs behind them only once
    counted = cut(counted.withColumn("cue", F.col("opening").rlike(f"(?U){REFUSAL}")))
    named = counted.join(minhash.clusters(counted.select(F.col("opening").alias("text"))).withColumnRenamed("text", "opening"), "opening")
    judged = named.groupBy("cluster").agg(
        F.sum("prompts").alias("recurs"),
        ((F.sum("bare") * 2 >= F.sum("n")) & ~F.max("supported")).alias("says_nothing"),
        (F.sum(F.when(F.col("cue"), F.col("n")).otherwise(0)) * 2 >= F.sum("n")).alias("declines"),
    )
    refuses = (
        F.when((F.col("recurs") >= UNLISTED) & F.col("says_nothing"), True).when(F.col("recurs") >= RECURS, F.col("declines")).otherwise(F.col("cue"))
    )
    return named.join(judged, "cluster").select("opening", refuses.alias("refuses"))


def defects(predictions: DataFrame, gold: DataFrame) -> DataFrame:
    """(prediction_id, defect) of every output without a usable answer; one kind for each such row.

    ``empty``: no text, marks or a placeholder only, or finished reasoning with no answer. ``truncated``:
    reasoning that is never closed, an output that ends before its answer, or an answer that ends within a
    word of the evidence. ``refusal``: the answer's opening belongs to a template that recurs across prompts and has nothing
    of gold, the question or names in it, or that declines in so many words.
    ``copied_question``: the question stands in place of the answer, once or again and again.
    ``other_language``: the answer's small words are of another language than the question's; names don't
    count. The last answer line counts. Null output, prediction and extraction together are ``empty``; with
    a null question nothing is a copy or in another language. Redelivered rows are judged each on its own.
    """
    rows = with_question(parsed(predictions), gold)
    a, q, ref = plain(F.col("answer")), plain(F.col("question")), plain(F.concat_ws(" ", "gold_answer", "prompt", "question"))
    rows = rows.select("*", F.coalesce(a, F.lit("")).alias("a"), q.alias("q"), ref.alias("ref"), plain(F.col("gold_answer")).alias("g"))
    squeezed = F.replace("a", F.lit(" "), F.lit(""))
    masked = F.concat(F.lower(F.substring("answer", 1, 1)), F.expr("substring(answer, 2)"))
    masked = F.regexp_replace(F.regexp_replace(masked, r"(?<![\p{L}'’])I(?![\p{L}])", "i"), _NAME, " # ")
    masked = F.regexp_replace(F.trim(F.regexp_replace(F.lower(masked), r"[^\p{L}\p{M}#]+", " ")), _JOINED, " ")
    quoted = F.contains(F.concat(F.lit(" "), F.col("ref"), F.lit(" ")), F.concat(F.lit(" "), F.col("a"), F.lit(" ")))
    rows = rows.withColumns(
        {
            "nothing": (squeezed == "") | squeezed.isin(*PLACEHOLDERS),
            "quoted": quoted,
            "opening": F.array_join(F.slice(F.split(F.regexp_replace(masked, r"#[# ]*(?=#)", ""), " "), 1, OPENING), " "),
            "phrase": F.split(F.trim(F.regexp_replace(masked, r"[# ]+", " ")), " "),
        }
    )
    aw, qw, gw = F.split("a", " "), F.split("q", " "), F.split("g", " ")
    judged = rows.where("NOT nothing AND NOT quoted AND NOT open_reasoning").select(
        "opening",
        "question",
        F.coalesce(_bare(qw, gw), F.lit(False)).alias("bare"),
        F.coalesce((F.col("g") != "") & (F.size(F.array_except(gw, aw)) == 0), F.lit(False)).alias("supported"),
    )
    rows = rows.join(templates(judged), "opening", "left")

    same, all_ = F.size(F.array_intersect(aw, qw)), F.size(F.array_union(aw, qw))
    times = F.greatest(F.round(F.size(aw) / F.size(qw)), F.lit(1))
    copied = (F.size(qw) >= 4) & (same >= 0.8 * all_) & (F.abs(F.size(aw) - times * F.size(qw)) <= 1 + 0.1 * F.size(qw))
    # each step is a projection of its own and reads what the one before has made
    rows = rows.withColumn("copied", copied)
    rows = rows.withColumn(
        "said", F.when(~F.col("quoted") & ~F.col("nothing") & ~F.col("open_reasoning") & ~F.col("copied"), language(F.col("phrase")))
    )
    rows = rows.withColumn("asked", F.when(F.col("said").isNotNull(), language(qw)))
    # a word or two say little: only what means yes or no in one language counts there
    few = F.arrays_overlap("phrase", F.split(F.lit(YES_OR_NO), " "))
    # and one word that is in one list only, where nothing else is of the question's language
    spoken = F.when(F.size(aw) <= 2, few).otherwise((F.col("said.n") >= 2) | (F.col("said.own") >= 1))
    foreign = (F.col("asked.language") != F.col("said.language")) & spoken
    # words beside a name or number, in letters that the question has none of; all alone they may be a name themselves
    letters = _other_letters(F.array_join("phrase", " "), F.col("q")) & (F.size(aw) > F.size("phrase")) & ~F.col("quoted") & ~F.col("copied")
    foreign = F.coalesce(foreign, F.lit(False)) | F.coalesce(letters, F.lit(False))

    padded = F.concat(F.lit(" "), F.col("ref"), F.lit(" "))
    last = F.element_at(aw, -1)
    tail = F.when(F.size(aw) > 1, F.concat_ws(" ", F.element_at(aw, -2), last)).otherwise(last)
    within = F.contains(padded, F.concat(F.lit(" "), tail)) & ~F.contains(padded, F.concat(F.lit(" "), tail, F.lit(" ")))
    number = F.col("a").rlike(r"^\p{N}+$")
    # a number or a yes or no is whole, even if the gold answer goes on with more letters
    closed = number | F.col("a").isin("yes", "no", *YES_OR_NO.split())
    cut_off = (within | (F.startswith(F.col("g"), F.col("a")) & (F.col("g") != F.col("a")))) & ~closed
    defect = (
        F.when(F.col("open_reasoning"), "truncated")
        .when(F.col("nothing"), "empty")
        .when(F.col("copied"), "copied_question")
        .when(F.coalesce("refuses", F.lit(False)), "refusal")
        .when(~F.col("has_line") & ~F.col("quoted") & _prose(), "truncated")
        .when(foreign, "other_language")
        .when(cut_off, "truncated")
        .when(~F.col("has_line") & ~F.col("quoted"), "truncated")
    )
    return rows.select("prediction_id", defect.alias("defect")).where("defect IS NOT NULL")


def _bare(question: Column, gold: Column) -> Column:
    """An answer that says nothing: no name or number, no word of gold or the question but small ones, no yes or no, the question's language."""
    small = F.split(F.lit(" ".join(SMALL_WORDS.values())), " ")
    own = F.array_except(F.array_intersect("phrase", F.array_union(question, F.coalesce(gold, F.array().cast("array<string>")))), small)
    plain_ = (F.size("phrase") >= BARE_WORDS) & ~F.contains("opening", F.lit("#")) & ~F.get("phrase", F.lit(0)).isin("yes", "no", *YES_OR_NO.split())
    whole = F.col("has_line") | ~_prose()
    said, asked = language(F.col("phrase")), language(question)
    spoken = F.coalesce(said.language == asked.language, F.lit(True))
    return F.when(plain_ & whole, F.when(F.size(own) == 0, spoken))


def _other_letters(phrase: Column, question: Column) -> Column:
    """Two words or more that are all in Cyrillic, Greek, Arabic, Hebrew or East Asian letters, with none of them in the question."""
    other = r"[\p{IsCyrillic}\p{IsGreek}\p{IsArabic}\p{IsHebrew}\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]"
    return phrase.rlike(rf"^{other}+(?: {other}+)+$") & ~question.rlike(other)


def _prose() -> Column:
    """Text without an answer line that goes on over a sentence, or stops within one: no answer of its own."""
    return F.col("answer").rlike(r"[.!?…]\s+\p{L}") | ~F.col("answer").rlike(r"[.!?…»\"')\]]\s*$")
