"""Ordered banding rules.

A rule set is an ordered list of ``(predicate, label)``; the first predicate
that is TRUE wins, a NULL predicate does not match, and rows matching nothing
get the default label.  ``band`` folds the list into one ``CASE WHEN``
expression, which Spark evaluates inside whole-stage code generation.

The cut-offs, codes and labels below are clinical definitions that must equal
the published ones for the categories to agree; they are written out as
fixed values.  Ranges are spelled with ``between_`` helpers whose bounds state
open/closed ends explicitly.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Rule = tuple[Column, str]


def band(rules: list[Rule], default: str) -> Column:
    """Fold ``rules`` into ``CASE WHEN p1 THEN l1 ... ELSE default END``."""
    if not rules:
        return F.lit(default)
    expr = F.when(rules[0][0], F.lit(rules[0][1]))
    for pred, label in rules[1:]:
        expr = expr.when(pred, F.lit(label))
    return expr.otherwise(F.lit(default))


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def closed_open(v: Column, lo, hi) -> Column:
    """lo <= v < hi"""
    return (v >= lo) & (v < hi)


def closed(v: Column, lo, hi) -> Column:
    """lo <= v <= hi"""
    return (v >= lo) & (v <= hi)


def open_closed(v: Column, lo, hi) -> Column:
    """lo < v <= hi"""
    return (v > lo) & (v <= hi)


def by_code(code: Column, values: dict[str, tuple]) -> Column:
    """Array of a code's numbers, from a constant map; NULL for other codes."""
    entries = [x for key, numbers in values.items() for x in (F.lit(key), F.array(*[F.lit(float(n)) for n in numbers]))]
    return F.try_element_at(F.create_map(*entries), code)


def null_or_zero(v: Column) -> Column:
    return v.isNull() | (v == 0)


# ---------------------------------------------------------------------------
# Body-mass index
# ---------------------------------------------------------------------------

INDETERMINABLE_BMI = "INDETERMINABLE"

# FIXED VALUES: adult BMI bands (kg/m2), lower bound closed, upper open,
# except the top of OBESE for a measured value which is closed at 55.
BMI_UNDERWEIGHT = (10, 18.5)
BMI_IDEAL = (18.5, 25)
BMI_OVERWEIGHT = (25, 30)
BMI_OBESE = (30, 55)
BMI_BORDER_IDEAL_TOP = 20
# Tags (BMI_CAT) whose code already states a category.
STATED_BMI_TAGS = ["UNDERWEIGHT", "IDEAL", "UNDER_IDEAL_BORDER", "OVERWEIGHT", "OBESE"]
BORDER_NULL_LABEL = "UNDER 20 NULLS"


def _measured_bmi_rules(v: Column) -> list[Rule]:
    return [
        (closed_open(v, *BMI_UNDERWEIGHT), "UNDERWEIGHT"),
        (closed_open(v, *BMI_IDEAL), "IDEAL"),
        (closed_open(v, *BMI_OVERWEIGHT), "OVERWEIGHT"),
        (closed(v, *BMI_OBESE), "OBESE"),
    ]


def adult_bmi_rules(tag="BMI_CAT", value="VALUE1_CONDITION") -> list[Rule]:
    """Adult BMI journal: measured codes are banded by value; stating codes
    keep their category when the value is empty (NULL or 0) or agrees with
    it; anything else is INDETERMINABLE (the default)."""
    t, v = _c(tag), _c(value)
    is_all = t == "ALL"
    rules: list[Rule] = [(is_all & v.isNull(), INDETERMINABLE_BMI)]
    rules += [(is_all & p, label) for p, label in _measured_bmi_rules(v)]
    rules += [
        ((t == "UNDERWEIGHT") & null_or_zero(v), "UNDERWEIGHT"),
        ((t == "IDEAL") & (null_or_zero(v) | closed_open(v, *BMI_IDEAL)), "IDEAL"),
        ((t == "UNDER_IDEAL_BORDER") & null_or_zero(v), BORDER_NULL_LABEL),
        ((t == "UNDER_IDEAL_BORDER") & closed_open(v, *BMI_UNDERWEIGHT), "UNDERWEIGHT"),
        ((t == "UNDER_IDEAL_BORDER") & closed(v, BMI_IDEAL[0], BMI_BORDER_IDEAL_TOP), "IDEAL"),
        ((t == "OVERWEIGHT") & (null_or_zero(v) | closed_open(v, *BMI_OVERWEIGHT)), "OVERWEIGHT"),
        ((t == "OBESE") & (null_or_zero(v) | closed_open(v, *BMI_OBESE)), "OBESE"),
        (t == "UNSUITABLE/DECLINED", "UNSUITABLE/DECLINED"),
        (t == "UNKNOWN", INDETERMINABLE_BMI),
        (t == "CHILD", "CHILD"),
    ]
    return rules


def computed_bmi_rules(bmi="BMI") -> list[Rule]:
    """BMI computed from height and weight."""
    b = _c(bmi)
    return [(b.isNull(), INDETERMINABLE_BMI)] + _measured_bmi_rules(b)


def child_bmi_rules(tag="BMI_CAT", value="VALUE1_CONDITION") -> list[Rule]:
    """Child BMI journal: a recorded value needs a growth-reference centile
    ('CENTILE'); stating codes with an empty value keep their category, and
    an UNDERWEIGHT code always stays UNDERWEIGHT."""
    t, v = _c(tag), _c(value)
    has_value = v.isNotNull() & (v != 0)
    return [
        ((t == "ALL") & v.isNull(), INDETERMINABLE_BMI),
        ((t == "ALL") & v.isNotNull(), "CENTILE"),
        (t == "UNDERWEIGHT", "UNDERWEIGHT"),
        ((t == "IDEAL") & null_or_zero(v), "IDEAL"),
        ((t == "IDEAL") & has_value, "CENTILE"),
        ((t == "UNDER_IDEAL_BORDER") & null_or_zero(v), BORDER_NULL_LABEL),
        ((t == "UNDER_IDEAL_BORDER") & has_value, "CENTILE"),
        ((t == "OVERWEIGHT") & null_or_zero(v), "OVERWEIGHT"),
        ((t == "OVERWEIGHT") & has_value, "CENTILE"),
        ((t == "OBESE") & null_or_zero(v), "OBESE"),
        ((t == "OBESE") & has_value, "CENTILE"),
        (t == "UNSUITABLE/DECLINED", "UNSUITABLE/DECLINED"),
        (t == "UNKNOWN", INDETERMINABLE_BMI),
        (t == "CHILD", "CHILD"),
    ]


# FIXED VALUES: child centile codes and the category each one states;
# every other CHILD code states IDEAL.
CHILD_CENTILE_UNDERWEIGHT = ["920141000000102", "920161000000101", "920181000000105"]
CHILD_CENTILE_OVERWEIGHT = ["920971000000105", "920991000000109"]
CHILD_CENTILE_OBESE = ["921011000000105", "921031000000102", "921051000000109"]


def child_code_rules(code="code") -> list[Rule]:
    c = _c(code)
    return [
        (c.isin(CHILD_CENTILE_UNDERWEIGHT), "UNDERWEIGHT"),
        (c.isin(CHILD_CENTILE_OVERWEIGHT), "OVERWEIGHT"),
        (c.isin(CHILD_CENTILE_OBESE), "OBESE"),
    ]


# FIXED VALUES: z-score cut-offs of the child growth reference.
Z_UNDERWEIGHT_MAX = -2
Z_OVERWEIGHT_MIN = 4 / 3
Z_OBESE_MIN = 2
Z_ERROR_LABEL = "ERROR"


def zscore_rules(z="BMI_Z_SCORE") -> list[Rule]:
    """z <= -2 UNDERWEIGHT, (-2, 4/3) IDEAL, [4/3, 2) OVERWEIGHT, >= 2 OBESE;
    NULL is ERROR (the default).  NaN sorts above every number, so it is
    OBESE, as in Spark SQL."""
    s = _c(z)
    return [
        (s <= Z_UNDERWEIGHT_MAX, "UNDERWEIGHT"),
        ((s > Z_UNDERWEIGHT_MAX) & (s < Z_OVERWEIGHT_MIN), "IDEAL"),
        ((s >= Z_OVERWEIGHT_MIN) & (s < Z_OBESE_MIN), "OVERWEIGHT"),
        (s >= Z_OBESE_MIN, "OBESE"),
    ]


# Complete label sets of each pipeline's final category (after removing the
# indeterminable ones); used to aggregate on label positions.
BMI_CATEGORIES = ["UNDERWEIGHT", "IDEAL", "UNDER 20 NULLS", "OVERWEIGHT", "OBESE"]

# Categories a child row must have to enter the combined BMI table.
KNOWN_CHILD_CATEGORIES = ["UNDERWEIGHT", "IDEAL", BORDER_NULL_LABEL, "OVERWEIGHT", "OBESE"]
# Categories removed from the adult branches.
UNUSABLE_ADULT_CATEGORIES = ["INDETERMINABLE", "UNSUITABLE/DECLINED", "CHILD"]


# ---------------------------------------------------------------------------
# Blood pressure
# ---------------------------------------------------------------------------

BP_INDETERMINABLE = "Indeterminable"

# FIXED VALUES: BP levels in rising order and their labels.
BP_LEVELS = ["Low", "Ideal", "Pre-High", "High"]
# Code-list TYPE_OF_JOURNAL value stating each level (note the space in
# "Pre-High Finding").
BP_FINDING_TYPES = ["Low-Finding", "Ideal-Finding", "Pre-High Finding", "High-Finding"]
# Plausible ranges (mmHg): systolic 70..190, diastolic 40..100.
SYS_MIN, SYS_MAX = 70, 190
DIA_MIN, DIA_MAX = 40, 100


# Break points of ``bp_value_rules``, systolic and diastolic.
BP_BREAKS = ([70, 90, 120, 140, 190], [40, 60, 80, 90, 100])


def bp_label(level: str, part: str = "") -> str:
    """'High Blood Pressure', 'High Systolic Blood Pressure', ..."""
    return f"{level} {part + ' ' if part else ''}Blood Pressure"


BP_CATEGORIES = [bp_label(lvl) for lvl in BP_LEVELS]


def bp_value_rules(sys="VALUE1_CONDITION", dia="VALUE2_CONDITION") -> list[Rule]:
    """Systolic/diastolic reading to a level; implausible values first."""
    s, d = _c(sys), _c(dia)
    return [
        ((s < SYS_MIN) | (s > SYS_MAX) | (d < DIA_MIN) | (d > DIA_MAX), BP_INDETERMINABLE),
        (closed_open(s, 70, 90) & closed_open(d, 40, 60), bp_label("Low")),
        ((closed_open(s, 90, 120) & closed_open(d, 40, 80))
         | (closed_open(s, 70, 90) & closed_open(d, 60, 80)), bp_label("Ideal")),
        ((closed_open(s, 120, 140) & closed_open(d, 40, 90))
         | (closed_open(s, 70, 120) & closed_open(d, 80, 90)), bp_label("Pre-High")),
        ((closed(s, 140, 190) & closed(d, 40, 100))
         | (closed_open(s, 70, 140) & closed(d, 90, 100)), bp_label("High")),
    ]


def bp_text_rules(part: str, kind="TYPE_OF_JOURNAL", value="VALUE1_CONDITION") -> list[Rule]:
    """A systolic or diastolic finding code without a value states a level."""
    k, v = _c(kind), _c(value)
    return [((k == t) & v.isNull(), bp_label(lvl, part)) for t, lvl in zip(BP_FINDING_TYPES, BP_LEVELS)]


def bp_level_number(label_col, part: str) -> Column:
    """0..3 for 'Low/Ideal/Pre-High/High <part> Blood Pressure', else NULL."""
    c = _c(label_col)
    expr = None
    for i, lvl in enumerate(BP_LEVELS):
        expr = (F.when(c == bp_label(lvl, part), F.lit(i)) if expr is None
                else expr.when(c == bp_label(lvl, part), F.lit(i)))
    return expr


def bp_combined_rules(breakdown="INITIAL_BREAKDOWN", kind="TYPE_OF_JOURNAL",
                      v1="VALUE1_CONDITION", v2="VALUE2_CONDITION",
                      sbp="SBP_CATS", dbp="DBP_CATS") -> list[Rule]:
    """Text-only readings: a whole-reading ('ALL') finding code states its
    level; a same-day systolic + diastolic pair of findings takes the higher
    of the two levels, and is Indeterminable if either side is."""
    b, k, a, z = _c(breakdown), _c(kind), _c(v1), _c(v2)
    whole = (b == "ALL") & a.isNull() & z.isNull()
    rules = [(whole & (k == t), bp_label(lvl)) for t, lvl in zip(BP_FINDING_TYPES, BP_LEVELS)]
    hi = F.greatest(bp_level_number(sbp, "Systolic"), bp_level_number(dbp, "Diastolic"))
    both = bp_level_number(sbp, "Systolic").isNotNull() & bp_level_number(dbp, "Diastolic").isNotNull()
    rules += [(both & (hi == i), bp_label(lvl)) for i, lvl in enumerate(BP_LEVELS)]
    return rules


# ---------------------------------------------------------------------------
# Blood glucose
# ---------------------------------------------------------------------------

GLUCOSE_INDETERMINABLE = "INDETERMINABLE"
GLUCOSE_CATEGORIES = ["LOW", "NORMAL", "PRE-DIABETES", "DIABETES", "MORE-TESTING-NEEDED"]
# Break points of ``glucose_fasting_rules``, fasting and two-hour value.
GLUCOSE_BREAKS = ([3.9, 4, 5.4, 5.5, 6.9, 7, 150], [4, 7.8, 11.1, 150])
SPECIMEN_TYPES = ["BLOOD", "PLASMA", "SERUM"]


def glucose_single_rules(kind="TYPE_OF_BLOOD_GLUCOSE_RECORD", fasting="FASTING_STATUS",
                         value="VALUE1_CONDITION") -> list[Rule]:
    """HbA1c (mmol/mol) and non-fasting / random glucose (mmol/L)."""
    k, f, v = _c(kind), _c(fasting), _c(value)
    hba1c = k == "HBA1C"
    spec = k.isin(SPECIMEN_TYPES)
    non_fasting = spec & (f == "NON-FASTING")
    rnd = spec & (f == "RANDOM")
    # FIXED VALUES: HbA1c 9/20/42/48/162; glucose 1/4/7.8/11.1/150.
    return [
        (hba1c & closed_open(v, 9, 20), "LOW"),
        (hba1c & closed_open(v, 20, 42), "NORMAL"),
        (hba1c & closed(v, 42, 48), "PRE-DIABETES"),
        (hba1c & open_closed(v, 48, 162), "DIABETES"),
        (non_fasting & closed_open(v, 1, 4), "LOW"),
        (non_fasting & closed_open(v, 4, 7.8), "NORMAL"),
        (non_fasting & closed_open(v, 7.8, 11.1), "PRE-DIABETES"),
        (non_fasting & closed(v, 11.1, 150), "DIABETES"),
        (rnd & closed_open(v, 1, 11.1), "MORE-TESTING-NEEDED"),
        (rnd & closed(v, 11.1, 150), "DIABETES"),
    ]


def glucose_fasting_rules(fasting_value="VALUE1_CONDITION", ogtt_value="VALUE2_CONDITION") -> list[Rule]:
    """Fasting value with an optional same-day two-hour (OGTT) value.  The
    gaps (5.4, 5.5) and (6.9, 7) in the fasting value are part of the
    definition."""
    v, w = _c(fasting_value), _c(ogtt_value)
    return [
        (closed(v, 4, 5.4) & closed_open(w, 4, 7.8), "NORMAL"),
        (closed_open(v, 4, 7) & closed_open(w, 7.8, 11.1), "PRE-DIABETES"),
        (closed(v, 5.5, 6.9) & closed_open(w, 4, 7.8), "PRE-DIABETES"),
        ((v >= 4) & (closed(v, 7, 150) | closed(w, 11.1, 150)), "DIABETES"),
        (closed(v, 3.9, 5.4) & w.isNull(), "NORMAL"),
        (closed(v, 5.5, 6.9) & w.isNull(), "PRE-DIABETES"),
        (closed(v, 7, 150) & w.isNull(), "DIABETES"),
    ]


# ---------------------------------------------------------------------------
# Smoking
# ---------------------------------------------------------------------------

SMOKING_INDETERMINABLE = "Indeterminable"
SMOKING_CATEGORIES = ["Current-Smoker", "Never-Smoker", "Non-Smoker History Unknown", "Ex-Smoker"]

# FIXED VALUES: value-bearing smoker codes and the inclusive value range in
# which the reading means "Smoker".
SMOKER_VALUE_RANGES = [
    ("160603005", 1, 9),
    ("160604004", 10, 19),
    ("160605003", 20, 39),
    ("160606002", 40, 100),
    ("266920004", 0, 1),
    ("56578002", 1, 20),
    ("56771006", 20, 100),
    ("59978006", 1, 20),
    ("65568007", 1, 100),
    ("77176002", 1, 100),
    ("82302008", 1, 100),
]
# FIXED VALUES: observable-entity codes.
OBSERVABLE_NON_SMOKER_IF_EMPTY = [
    "160625004", "230056004", "230057008", "230058003", "266918002",
    "401201003", "413173009", "836001000000109", "228486009", "735112005",
]
OBSERVABLE_NON_SMOKER_IF_NON_NEGATIVE = ["160625004", "735112005"]
OBSERVABLE_NON_SMOKER_IF_ZERO = ["230056004", "266918002", "401201003"]
# (code, low, high, low is inclusive) -> Smoker when the value is in range.
OBSERVABLE_SMOKER_RANGES = [
    ("230056004", 0, 100, False),
    ("230057008", 0, 20, False),
    ("230058003", 0, 100, False),
    ("266918002", 0, 100, False),
    ("401201003", 0, 240, False),
    ("413173009", 0, 1440, True),
    ("836001000000109", 0, 100, False),
]
OBSERVABLE_SMOKER_IF_EMPTY = ["401159003"]


def smoking_rules(category="CATEGORY", code="CODE", value="VALUE1_CONDITION") -> list[Rule]:
    cat, c, v = _c(category), _c(code), _c(value)
    empty = v.isNull()
    rules: list[Rule] = [
        ((cat == "non_smoker_findings_codes") & empty, "Non-Smoker"),
        ((cat == "smoker_findings_codes") & empty, "Smoker"),
        ((cat == "Microtest_Error") & null_or_zero(v), "Non-Smoker"),
        ((cat == "Value_Finding_Smoker") & empty, "Smoker"),
    ]
    # The ranges of codes are looked up rather than compared one by one, which keeps the generated method small.
    vfs, own = cat == "Value_Finding_Smoker", by_code(c, {code_: (lo, hi) for code_, lo, hi in SMOKER_VALUE_RANGES})
    rules.append((vfs & closed(v, own[0], own[1]), "Smoker"))
    rules.append(((cat == "Value_Finding_Non_Smoker") & empty, "Non-Smoker"))
    obs = cat == "Observable_Entities"
    rules += [
        (obs & c.isin(OBSERVABLE_NON_SMOKER_IF_EMPTY) & empty, "Non-Smoker"),
        (obs & c.isin(OBSERVABLE_NON_SMOKER_IF_NON_NEGATIVE) & (v >= 0), "Non-Smoker"),
        (obs & c.isin(OBSERVABLE_NON_SMOKER_IF_ZERO) & (v == 0), "Non-Smoker"),
    ]
    seen = by_code(c, {code_: (lo, hi, float(lo_in)) for code_, lo, hi, lo_in in OBSERVABLE_SMOKER_RANGES})
    rules.append((obs & (open_closed(v, seen[0], seen[1]) | ((seen[2] == 1) & (v == seen[0]))), "Smoker"))
    rules.append((obs & c.isin(OBSERVABLE_SMOKER_IF_EMPTY) & empty, "Smoker"))
    return rules


# FIXED VALUES: data-dictionary smoking status of non-smoker codes.
NEVER_SMOKER_CODES = ["221000119102", "266919005"]
NEVER_SMOKER_IF_EMPTY = ["401201003"]
HISTORY_UNKNOWN_CODES = [
    "105539002", "105540000", "105541001", "160618006", "360918006",
    "360929005", "405746006", "8392000", "87739003",
]


def smoking_dictionary_rules(status="SMOKING_CATS", code="CODE", value="VALUE1_CONDITION") -> list[Rule]:
    """Smoker -> Current-Smoker; Non-Smoker -> Never-Smoker, 'Non-Smoker
    History Unknown' or (default) Ex-Smoker by code."""
    s, c, v = _c(status), _c(code), _c(value)
    non = s == "Non-Smoker"
    return [
        (s == "Smoker", "Current-Smoker"),
        (s == SMOKING_INDETERMINABLE, SMOKING_INDETERMINABLE),
        (non & c.isin(NEVER_SMOKER_CODES), "Never-Smoker"),
        (non & c.isin(NEVER_SMOKER_IF_EMPTY) & null_or_zero(v), "Never-Smoker"),
        (non & c.isin(HISTORY_UNKNOWN_CODES), "Non-Smoker History Unknown"),
    ]
