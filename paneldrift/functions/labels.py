"""Classification rules as column expressions.

Every rule follows the three-valued logic of SQL: a condition on a missing value does not match.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import col, is_any

# --- Fixed values: labels, thresholds, lookup rows and colours that results must carry verbatim ---

MONO, PLURI = "monospecifique", "plurispecifique"
DOMINANCE = 0.8

QUARTILE_LABELS = ("0–25%", "25–50%", "50–75%", "75–100%")

PRESENT, ABSENT = "presence", "absence"
LIKELIHOODS = ("faible", "moyen", "fort")

EVOLUTIONS = ("disp", "exp", "declin")
AGREE, DISAGREE = "OK", "pasOK"

BELTS = {
    "Abies_alba": "montagnard",
    "Pinus_sylvestris": "montagnard",
    "Picea_abies": "montagnard",
    "Carpinus_betulus": "plaine",
    "Quercus_robur": "plaine",
    "Quercus_petraea": "plaine",
    "Fagus_sylvatica": "plaine",
    "Pinus_pinaster": "mediterraneen",
    "Pinus_halepensis": "mediterraneen",
    "Quercus_ilex": "mediterraneen",
    "Quercus_pubescens": "mediterraneen",
}

RELATION_GOOD = "Forte (bonne note → haute croissance)"
RELATION_BAD = "Forte (bonne note → basse croissance)"
RELATION_WEAK = "Faible / Non significative"

TEXT_UNDEFINED = "Non calculable (trop peu de notes distinctes)"
TEXT_NO_LINK = "Aucun lien significatif entre note et croissance"
TEXT_EXPECTED = "Relation attendue : les bonnes notes sont associées à une meilleure croissance"
TEXT_REVERSED = "Relation inversée : les mauvaises notes montrent une croissance plus forte"
TEXT_OTHER = "Cas particulier"

LOSS_COLOURS = {"0–25%": "white", "25–50%": "#ffcccc", "50–75%": "#ff6666", "75–100%": "red"}
APPEAR_COLOURS = {"0–25%": "white", "25–50%": "#ccffcc", "50–75%": "#66cc66", "75–100%": "green"}
PRESENCE_COLOURS = {"presence": "green", "absence": "red"}
LIKELIHOOD_COLOURS = {"faible": "red", "moyen": "orange", "fort": "green"}
AGREEMENT_COLOURS = {"OK": "green", "pasOK": "red"}
RELATION_COLOURS = {RELATION_GOOD: "#2E8B57", RELATION_BAD: "#E74C3C", RELATION_WEAK: "lightgrey"}

# --- End of fixed values ---


def stand_type(max_share: str | Column, threshold: float = DOMINANCE) -> Column:
    """One dominant species or a mixture; a plot without any share counts as a mixture."""
    return F.when(col(max_share) >= threshold, MONO).otherwise(PLURI)


def quartile_class(pct: str | Column) -> Column:
    """Right-closed quarters of 0..100, the first one closed on both sides; null outside."""
    x = col(pct)
    first, second, third, last = QUARTILE_LABELS
    return (
        F.when((x >= 0) & (x <= 25), first)
        .when((x > 25) & (x <= 50), second)
        .when((x > 50) & (x <= 75), third)
        .when((x > 75) & (x <= 100), last)
    )


def presence(end_value: str | Column, threshold: float = 1.0) -> Column:
    x = col(end_value)
    return F.when(x > threshold, PRESENT).when(x <= threshold, ABSENT)


def presence_likelihood(
    state: str | Column,
    pct_loss: str | Column,
    pct_appear: str | Column,
    pct_growth: str | Column,
    loss_threshold: float = 50.0,
) -> Column:
    here = col(state) == PRESENT
    low, middle, high = LIKELIHOODS
    return (
        F.when(here & (col(pct_loss) > loss_threshold), low)
        .when(here & (col(pct_loss) <= loss_threshold), middle)
        .when(here & ((col(pct_appear) > 0) | (col(pct_growth) > 0)), high)
    )


def evolution_from_shares(
    start: str | Column, end: str | Column, major: float = 0.1, minor: float = 0.01
) -> Column:
    """Compares shares directly rather than their ratio, so a start share of zero is an expansion."""
    a, b = col(start), col(end)
    gone, grows, shrinks = EVOLUTIONS
    return (
        F.when((a > major) & (b < minor), gone)
        .when((b > major) & (b > a), grows)
        .when((a > major) & (b < a) & (b > minor), shrinks)
    )


def evolution_from_growth(
    growth_pct: str | Column, share_shift: str | Column, total_ini: str | Column, total_fin: str | Column
) -> Column:
    g = col(growth_pct)
    gone, grows, shrinks = EVOLUTIONS
    gains = (col(share_shift) > 0) & (col(total_fin) - col(total_ini) > 0)
    return F.when(g == -100, gone).when((g > 0) | gains, grows).when(g < 0, shrinks)


def agreement(evolution: str | Column, grade: str | Column) -> Column:
    """Decline is expected under a poor grade (2, 3), expansion under the best one (1)."""
    _, grows, shrinks = EVOLUTIONS
    expected = ((col(evolution) == shrinks) & is_any(grade, (2, 3))) | (
        (col(evolution) == grows) & is_any(grade, (1,))
    )
    return F.when(expected, AGREE).otherwise(DISAGREE)


def relation(rho: str | Column, p: str | Column, alpha: float = 0.05) -> Column:
    strong = col(p) < alpha
    return (
        F.when(strong & (col(rho) < 0), RELATION_GOOD)
        .when(strong & (col(rho) > 0), RELATION_BAD)
        .otherwise(RELATION_WEAK)
    )


def interpretation(rho: str | Column, p: str | Column, alpha: float = 0.05) -> Column:
    return (
        F.when(col(p).isNull(), TEXT_UNDEFINED)
        .when(col(p) >= alpha, TEXT_NO_LINK)
        .when(col(rho) < 0, TEXT_EXPECTED)
        .when(col(rho) > 0, TEXT_REVERSED)
        .otherwise(TEXT_OTHER)
    )


def excludes_zero(lower: str | Column, upper: str | Column) -> Column:
    return (col(lower) > 0) | (col(upper) < 0)


def colour(label: str | Column, colours: dict[str, str]) -> Column:
    """Colour of a class, null for an unlisted one."""
    rule = None
    for key, value in colours.items():
        rule = F.when(col(label) == key, value) if rule is None else rule.when(col(label) == key, value)
    return rule
