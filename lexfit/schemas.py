"""Record layouts."""

from pyspark.sql import types as T

STR, STRS = T.StringType(), T.ArrayType(T.StringType())
DBL, LONG = T.DoubleType(), T.LongType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


PAGE = _struct(("page_id", LONG), ("url", STR), ("html", STR))

# One collected ad. batch_no and pos give the order that keep-first needs.
RECORD = _struct(
    ("url", STR), ("title", STR), ("company", STR), ("address", STRS), ("parts", STRS),
    ("batch_no", LONG), ("pos", LONG),
)

SECTIONS = ("tasks", "profile", "benefits")
TOKEN_STEPS = ("clean", "lemma", "stem1", "stem2", "no_stop")
MEASURES = ("cosine", "cosine_rank", "jaccard", "jaccard_rank", "rank_diff")

# The job store: identity, parts, found values, then the columns each stage fills.
STORE = T.StructType(
    _struct(("job_id", STR)).fields
    + RECORD.fields
    + _struct(
        ("lang", STR), ("email", STR),
        ("tasks", STR), ("profile", STR), ("benefits", STR), ("contact", STR),
    ).fields
    + [T.StructField(f"{s}_{step}", STRS) for step in TOKEN_STEPS for s in SECTIONS]
    + [T.StructField(f"{s}_joined", STR) for s in SECTIONS]
    + [T.StructField(f"{s}_{m}", DBL) for s in SECTIONS for m in MEASURES]
    + _struct(
        ("tasks_matched", STR), ("profile_matched", STR),
        ("total_cosine", DBL), ("total_jaccard", DBL),
        ("letter_text", STR), ("letter_done", STR), ("file_name", STR), ("sent", STR),
    ).fields
)

TERMS = _struct(("section", STR), ("pos", LONG), ("term", STR))
