"""The points calculator: lookups by single or accompanied applicants, and caps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Points by age, education, language level and years of work, (single, accompanied).
AGE = {
    17: (0, 0), 18: (99, 90), 19: (105, 95), **{a: (110, 100) for a in range(20, 30)}, 30: (105, 95), 31: (99, 90), 32: (94, 85), 33: (88, 80), 34: (83, 75), 35: (77, 70), 36: (72, 65),
    37: (66, 60), 38: (61, 55), 39: (55, 50), 40: (50, 45), 41: (39, 35), 42: (28, 25), 43: (17, 15), 44: (6, 5), 45: (0, 0),
}
EDUCATION = {"none": (0, 0), "secondary": (30, 28), "1-year": (90, 84), "2-year": (98, 91), "bachelor": (120, 112), "two-plus": (128, 119), "masters": (135, 126), "professional": (135, 126), "phd": (150, 140)}
LANGUAGE = {4: (0, 0), 5: (6, 6), 6: (9, 8), 7: (16, 15), 8: (22, 20), 9: (31, 29), 10: (34, 32), 11: (34, 32), 12: (34, 32)}
WORK = {0: (0, 0), 1: (40, 35), 2: (53, 46), 3: (64, 56), 4: (72, 63), 5: (80, 70)}
SPOUSE_EDUCATION = {"secondary": 2, "1-year": 6, "2-year": 7, "bachelor": 8, "two-plus": 9, "masters": 10, "professional": 10, "phd": 10}
LOCAL_EDUCATION = {"none": 0, "1-year": 15, "2-year": 15, "bachelor": 15, "2-plus": 15, "masters": 15, "phd": 30}
ADVANCED = ("masters", "professional", "phd", "two-plus")
SPOUSE_LANGUAGE = ((9, 5), (7, 4), (6, 3), (5, 2), (4, 1))
# End of fixed values.

SKILLS = ("reading", "writing", "speaking", "listening")


def _table(values: dict, key: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key), F.lit(0))


def _pair(values: dict, key: Column, spouse: Column) -> Column:
    return F.when(spouse, _table({k: v[1] for k, v in values.items()}, key)).otherwise(_table({k: v[0] for k, v in values.items()}, key))


def score(p: Column) -> Column:
    """The points of a profile struct: age, education, language, work, spouse, transfer, additional and total."""
    spouse, low = p["has_spouse"], F.least(*[p[f"clb_{s}"] for s in SKILLS])
    age, education = _pair(AGE, p["age"], spouse), _pair(EDUCATION, p["education"], spouse)
    language = sum((_pair(LANGUAGE, p[f"clb_{s}"], spouse) for s in SKILLS), F.lit(0))
    work = _pair(WORK, F.greatest(F.least(p["local_work"], F.lit(5)), F.lit(0)), spouse)

    def step(level: Column) -> Column:
        return F.coalesce(*[F.when(level >= least, n) for least, n in SPOUSE_LANGUAGE], F.lit(0))

    partner = _table(SPOUSE_EDUCATION, p["spouse_education"]) + sum((step(p[f"spouse_clb_{s}"]) for s in SKILLS), F.lit(0)) + F.when(p["spouse_work"] >= 1, 10).otherwise(0)
    partner = F.when(spouse, partner).otherwise(0)
    half = lambda *tests: F.when(tests[0] & tests[1], 50).otherwise(0)
    advanced, fluent, local, abroad = p["education"].isin(*ADVANCED), low >= 9, p["local_work"] >= 1, p["foreign_work"] >= 3
    transfer = F.least(F.lit(100), half(advanced, fluent) + half(advanced, local) + half(abroad, fluent) + half(abroad, local))
    french = F.when(p["french_clb"] >= 7, F.when(low >= 5, 50).otherwise(25)).otherwise(0)
    additional = F.when(p["nominated"], 600).otherwise(0) + _table(LOCAL_EDUCATION, p["local_education"]) + french + F.when(p["sibling"], 15).otherwise(0)
    return F.struct(age.alias("age"), education.alias("education"), language.alias("language"), work.alias("work"), partner.alias("spouse"), transfer.alias("transfer"), additional.alias("additional"), (age + education + language + work + partner + transfer + additional).alias("total"))


def breakdown(points: Column, spouse: Column) -> Column:
    """(category, points, most) of each part of a score; the spouse's only with one, additional points only if there are any."""
    part = lambda name, value, most: F.struct(F.lit(name).alias("category"), value.alias("points"), most.alias("most"))
    two = lambda single, both: F.when(spouse, both).otherwise(single)
    return F.array_compact(F.array(
        part("Age", points["age"], two(110, 100)), part("Education", points["education"], two(150, 140)), part("First Official Language", points["language"], two(136, 128)),
        part("Canadian Work Experience", points["work"], two(80, 70)), F.when(spouse, part("Spouse Factors", points["spouse"], F.lit(40))), part("Skill Transferability", points["transfer"], F.lit(100)),
        F.when(points["additional"] > 0, part("Additional Points", points["additional"], F.lit(600))),
    ))
