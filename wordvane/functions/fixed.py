"""Word lists, thresholds and tables that results depend on, as data."""

from __future__ import annotations

# Stop words of key units.
STOP_WORDS = tuple(
    """a an the is are was were be been being have has had do does did will would could should may might shall can need dare
    ought used to of in for on with at by from as into through during before after above below between out off over under
    again further then once here there when where why how all both each few more most other some such no nor not only own
    same so than too very just don now and but or if while that this what which who whom these those its his her their our
    your my he she it we they them him me us said also about up one two like much many well back even still way take come
    make know get got say says see go went tell told think thought give gave put""".split()
)

# Common words that are never counted as made up.
COMMON_WORDS = tuple(
    """also however therefore although because while since after before during about between through within without along
    above below under over into upon toward towards across said says told made came went been being have having does doing
    would could should might must will shall were become becomes became taken given known shown found used called based
    noted added expected reported according including following leading reaching making taking getting going coming looking
    working turning running playing starting more most many much some other such only even well still just very than when
    then here there where both each every like same different several various another certain particular especially
    particularly recently currently previously significantly approximately potentially dramatically effectively people time
    year years part case point fact place thing things world life work system number group area level result report data
    information process study research team market production technology development that this these those their them they
    what which whom your with from""".split()
)

# Stop words of anchor tokens.
ANCHOR_STOP_WORDS = tuple(
    """a an the and or but if of to in on at by for with as is are was were be been being do does did doing have has had
    having this that these those i you he she it we they them us him her my your his their our its from into out up down so
    than then too very can will just not no nor only""".split()
)

# Expanded and contracted forms.
CONTRACTIONS = (
    (" do not ", " don't "), (" does not ", " doesn't "), (" did not ", " didn't "), (" is not ", " isn't "), (" are not ", " aren't "),
    (" was not ", " wasn't "), (" were not ", " weren't "), (" cannot ", " can't "), (" will not ", " won't "), (" would not ", " wouldn't "),
    (" I am ", " I'm "), (" you are ", " you're "), (" they are ", " they're "), (" we are ", " we're "), (" it is ", " it's "),
)

# Hedges.
HEDGES = ("It seems that", "It might be the case that", "Arguably,", "Some might say", "It could be argued that")

# Starts of lines that are talk about a generation, not part of it.
META_LINES = ("note:", "explanation:", "i ", "here ", "this ", "the original", "(note", "changes made", "key changes")

# Names of rewriting strategies, and those allowed for each task.
STRATEGIES = tuple(
    "formal_tone casual_tone reordered_clauses synonyms concise different_structure different_opening role_prefix passive_voice question_form imperative elaborated technical_vocab simple_vocab split_sentences merged_sentences".split()
)
STRATEGIES_BY_TASK = {
    "summarization": tuple("formal_tone casual_tone reordered_clauses synonyms concise different_structure different_opening role_prefix passive_voice imperative elaborated technical_vocab simple_vocab split_sentences merged_sentences".split()),
    "creative": tuple("formal_tone casual_tone reordered_clauses synonyms different_structure different_opening passive_voice elaborated technical_vocab simple_vocab split_sentences merged_sentences".split()),
    "dialogue": tuple("formal_tone casual_tone reordered_clauses synonyms different_structure different_opening elaborated technical_vocab simple_vocab".split()),
    "qa": tuple("formal_tone casual_tone reordered_clauses synonyms different_structure different_opening elaborated technical_vocab simple_vocab".split()),
}

# Similarity bands, gates and caps.
SIMILARITY_LOW, SIMILARITY_HIGH, SIMILARITY_LOW_BY_TASK = 0.82, 0.98, {"dialogue": 0.78}
OVERLAP_MOST, LEAST_WORDS, PER_STRATEGY = 0.85, 5, 2
HISTOGRAM_EDGES = (0.0, 0.70, 0.75, 0.80, 0.82, 0.85, 0.90, 0.95, 1.01)

# Weights of composite scores.
PRI_WEIGHTS, SHORT_LENGTH, SHORT_FACTOR = (0.40, 0.35, 0.25), 12, 0.85
FINAL_WEIGHTS = (0.6, 0.4)
DIAGNOSTIC_ORI_WEIGHTS, DIAGNOSTIC_IFI_WEIGHTS, DIAGNOSTIC_PRI_WEIGHTS = (0.40, 0.30, 0.20, 0.10), (0.50, 0.30, 0.20), (0.5, 0.5)
DIAGNOSIS_AT = 0.70

#: The pool of instructions: similarity to the canonical one from, to; most word overlap with it; least words.
POOL_SIMILARITY, POOL_OVERLAP, POOL_WORDS = (0.82, 0.98), 0.85, 6
