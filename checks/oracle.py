"""The registered queries as plain SQL, written from the definitions and not from the Spark code.

The SQL always works on the dense panel with explicit zeros; where the library reads the sparse panel and
treats absent cells as zero, equal results show that the two readings agree.
"""

from __future__ import annotations

from types import SimpleNamespace

# --- Fixed values: labels and colours that results must carry, written out again so that a slip in the library shows ---

labels = SimpleNamespace(
    MONO="monospecifique",
    PLURI="plurispecifique",
    QUARTILE_LABELS=("0–25%", "25–50%", "50–75%", "75–100%"),
    RELATION_GOOD="Forte (bonne note → haute croissance)",
    RELATION_BAD="Forte (bonne note → basse croissance)",
    RELATION_WEAK="Faible / Non significative",
    TEXT_UNDEFINED="Non calculable (trop peu de notes distinctes)",
    TEXT_NO_LINK="Aucun lien significatif entre note et croissance",
    TEXT_EXPECTED="Relation attendue : les bonnes notes sont associées à une meilleure croissance",
    TEXT_REVERSED="Relation inversée : les mauvaises notes montrent une croissance plus forte",
    TEXT_OTHER="Cas particulier",
    LOSS_COLOURS={"0–25%": "white", "25–50%": "#ffcccc", "50–75%": "#ff6666", "75–100%": "red"},
    APPEAR_COLOURS={"0–25%": "white", "25–50%": "#ccffcc", "50–75%": "#66cc66", "75–100%": "green"},
    PRESENCE_COLOURS={"presence": "green", "absence": "red"},
    LIKELIHOOD_COLOURS={"faible": "red", "moyen": "orange", "fort": "green"},
    AGREEMENT_COLOURS={"OK": "green", "pasOK": "red"},
    RELATION_COLOURS={
        "Forte (bonne note → haute croissance)": "#2E8B57",
        "Forte (bonne note → basse croissance)": "#E74C3C",
        "Faible / Non significative": "lightgrey",
    },
)

# Coefficients of the published rational approximation AS 241 (double precision): centre and middle part.
CENTRE_TOP = (
    3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4,
    4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3,
)
CENTRE_BOTTOM = (
    1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
    2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3,
)
MIDDLE_TOP = (
    1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0,
    1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4,
)
MIDDLE_BOTTOM = (
    1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
    1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9,
)

# --- End of fixed values ---

BRANDS = [f"Brand#{i}" for i in range(1, 26)]
BOOT_ITER, BOOT_SEED = 5000, 7


def r(expr: str, name: str | None = None, digits: int = 6) -> str:
    """Rounded by plain arithmetic, as on the other side of the comparison."""
    return f"CAST(floor(({expr}) * 1e{digits} + 0.5001) / 1e{digits} AS DOUBLE) AS {name or expr}"


def rr(*names: str) -> str:
    return ", ".join(r(n) for n in names)


PANEL = """
cell AS (
  SELECT l_suppkey AS plot, l_returnflag AS scenario, p_brand AS species,
         CAST(year(l_shipdate) AS INT) AS year, SUM(l_quantity) AS value
  FROM lineitem JOIN part ON l_partkey = p_partkey
  GROUP BY l_suppkey, l_returnflag, p_brand, CAST(year(l_shipdate) AS INT)),
panel AS (
  SELECT p.plot, p.scenario, s.species, y.year, COALESCE(c.value, 0.0) AS value
  FROM (SELECT DISTINCT plot, scenario FROM cell) p
  CROSS JOIN (SELECT DISTINCT species FROM cell) s
  CROSS JOIN (SELECT DISTINCT year FROM cell) y
  LEFT JOIN cell c ON c.plot = p.plot AND c.scenario = p.scenario AND c.species = s.species AND c.year = y.year)"""

SITE = """
site AS (
  SELECT s_suppkey AS plot, r_name AS greco, n_name AS ser, s_acctbal AS alt,
         CASE WHEN s_suppkey % 17 = 0 THEN NULL ELSE CAST(-6.0 + (s_suppkey * 37 % 160) / 10.0 AS DOUBLE) END AS lon,
         CASE WHEN s_suppkey % 17 = 0 THEN NULL ELSE CAST(40.5 + (s_suppkey * 53 % 120) / 10.0 AS DOUBLE) END AS lat
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

GRADE = """
grade AS (
  SELECT plot, species, CASE WHEN k < 5 THEN 1 WHEN k < 8 THEN 2 ELSE 3 END AS grade
  FROM (SELECT plot, species, (plot * 7 + CAST(substr(species, 7) AS INT) * 3) % 10 AS k
        FROM (SELECT DISTINCT plot, species FROM panel) q) g
  WHERE k < 9)"""

BELT = """
belt AS (
  SELECT species, CASE k WHEN 0 THEN 'montagnard' WHEN 1 THEN 'plaine' ELSE 'mediterraneen' END AS belt
  FROM (SELECT DISTINCT species, CAST(substr(species, 7) AS INT) % 4 AS k FROM cell) b WHERE k < 3)"""


def indicator_ctes(scenario: str = "N", fin: str | None = None, name: str = "ind", source: str = "panel") -> str:
    """two-date table, totals, indicators and stand type of one scenario."""
    fin = fin or "MAX(CASE WHEN year = 2001 THEN value END)"
    return f"""
{name}_two AS (
  SELECT plot, species, MAX(CASE WHEN year = 1995 THEN value END) AS ini, {fin} AS fin
  FROM {source} WHERE scenario = '{scenario}' GROUP BY plot, species),
{name}_tot AS (
  SELECT *, SUM(ini) OVER (PARTITION BY plot) AS total_ini, SUM(fin) OVER (PARTITION BY plot) AS total_fin
  FROM {name}_two),
{name}_pre AS (
  SELECT *, fin - ini AS evol, CASE WHEN ini > 0 THEN fin * 100 / ini - 100 END AS growth_pct,
         fin * 100 / NULLIF(total_fin, 0) - ini * 100 / NULLIF(total_ini, 0) AS share_shift
  FROM {name}_tot WHERE NOT (ini = 0 AND fin = 0)),
{name} AS (
  SELECT *, MAX(ini / NULLIF(total_ini, 0)) OVER (PARTITION BY plot) AS max_share,
         CASE WHEN MAX(ini / NULLIF(total_ini, 0)) OVER (PARTITION BY plot) >= 0.15
              THEN 'monospecifique' ELSE 'plurispecifique' END AS stand_type
  FROM {name}_pre)"""


SMOOTH = "AVG(CASE WHEN year BETWEEN 1999 AND 2001 THEN value END)"

EVOLUTION = """CASE WHEN growth_pct = -100 THEN 'disp'
              WHEN growth_pct > 0 OR (share_shift > 0 AND total_fin - total_ini > 0) THEN 'exp'
              WHEN growth_pct < 0 THEN 'declin' END"""

IND = indicator_ctes()

ANALYSED = f"{PANEL},{IND},{GRADE}," + f"""
ana AS (
  SELECT i.*, g.grade, {EVOLUTION} AS evolution
  FROM ind i LEFT JOIN grade g ON g.plot = i.plot AND g.species = i.species),
judged AS (
  SELECT *, CASE WHEN (evolution = 'declin' AND grade IN (2, 3)) OR (evolution = 'exp' AND grade = 1)
                 THEN 'OK' ELSE 'pasOK' END AS agreement FROM ana),
growths AS (SELECT * FROM ana WHERE growth_pct IS NOT NULL AND grade IS NOT NULL)"""

SHARES = f"""{PANEL},
sh AS (
  SELECT plot, species, year, value, SUM(value) OVER (PARTITION BY plot, year) AS total,
         value / NULLIF(SUM(value) OVER (PARTITION BY plot, year), 0) AS share
  FROM panel WHERE scenario = 'N'),
sc AS (
  SELECT plot, species, MAX(CASE WHEN year = 1995 THEN share END) AS share_start,
         MAX(CASE WHEN year = 2001 THEN share END) AS share_end,
         MAX(CASE WHEN year = 1998 THEN share END) AS share_before
  FROM sh GROUP BY plot, species)"""


def quarters(x: str) -> str:
    a, b, c, d = labels.QUARTILE_LABELS
    return (
        f"CASE WHEN {x} >= 0 AND {x} <= 25 THEN '{a}' WHEN {x} > 25 AND {x} <= 50 THEN '{b}' "
        f"WHEN {x} > 50 AND {x} <= 75 THEN '{c}' WHEN {x} > 75 AND {x} <= 100 THEN '{d}' END"
    )


METRICS = f"""{PANEL},{SITE},
kept AS (
  SELECT plot, species FROM panel WHERE scenario = 'N' AND year IN (1995, 2001)
  GROUP BY plot, species HAVING NOT bool_and(value = 0)),
held AS (
  SELECT p.* FROM panel p JOIN kept k ON k.plot = p.plot AND k.species = p.species
  WHERE scenario = 'N' AND year IN (1995, 2001)),
se AS (
  SELECT plot, species, COALESCE(SUM(CASE WHEN year = 1995 THEN value END), 0) AS start_value,
         COALESCE(SUM(CASE WHEN year = 2001 THEN value END), 0) AS end_value
  FROM held GROUP BY plot, species),
tot AS (
  SELECT plot, SUM(CASE WHEN year = 1995 THEN value END) AS total_start,
         SUM(CASE WHEN year = 2001 THEN value END) AS total_end FROM held GROUP BY plot),
m1 AS (
  SELECT se.*, total_start, total_end,
         CASE WHEN start_value > 0 THEN end_value - start_value END AS diff_abs,
         CASE WHEN start_value > 0 AND start_value >= end_value
              THEN (start_value - end_value) / NULLIF(start_value, 0) * 100 END AS pct_loss,
         CASE WHEN start_value = 0 THEN end_value / NULLIF(total_end, 0) * 100 END AS pct_appear
  FROM se JOIN tot ON tot.plot = se.plot),
m2 AS (
  SELECT *, CASE WHEN pct_loss IS NULL AND pct_appear IS NULL
                 THEN end_value / NULLIF(total_end, 0) * 100 - start_value / NULLIF(total_start, 0) * 100 END AS pct_growth,
         {quarters("pct_loss")} AS loss_class, {quarters("pct_appear")} AS appear_class,
         CASE WHEN end_value > 1 THEN 'presence' ELSE 'absence' END AS presence
  FROM m1),
met AS (
  SELECT *, CASE WHEN presence = 'presence' AND pct_loss > 50 THEN 'faible'
                 WHEN presence = 'presence' AND pct_loss <= 50 THEN 'moyen'
                 WHEN (presence = 'presence' AND pct_appear > 0) OR (presence = 'presence' AND pct_growth > 0)
                 THEN 'fort' END AS likelihood
  FROM m2)"""

MODELS = f"""{PANEL},{indicator_ctes("A", name="im")},{indicator_ctes("R", name="ip")},
pairs AS (
  SELECT m.plot, 'Species_' || substr(m.species, 7) AS species_latin,
         m.growth_pct AS value_m, p.growth_pct AS value_p
  FROM im m JOIN ip p ON m.plot = p.plot AND m.species = p.species)"""


def simpson(f: str, upper: str, steps: int = 2000) -> str:
    """Integral of f(x) from 0 to upper by Simpson's rule."""
    weight = f"CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    at = f.replace("{x}", f"(i * ({upper}) / {steps}.0)")
    return f"(list_sum(list_transform(range(0, {steps + 1}), lambda i: ({weight}) * {at})) * ({upper}) / {steps}.0 / 3)"


def student_p(t: str, df: str) -> str:
    density = f"pow(1 + {{x}} * {{x}} / ({df}), -(({df}) + 1) / 2.0)"
    scale = f"exp(lgamma((({df}) + 1) / 2.0) - lgamma(({df}) / 2.0)) / sqrt(({df}) * pi())"
    return f"CASE WHEN {t} IS NOT NULL THEN greatest(0.0, 1 - 2 * {scale} * {simpson(density, f'abs({t})')}) END"


def normal_p(z: str) -> str:
    density = "exp(-{x} * {x} / 2.0)"
    return f"CASE WHEN {z} IS NOT NULL THEN greatest(0.0, 1 - 2 / sqrt(2 * pi()) * {simpson(density, f'abs({z})')}) END"


def below_normal(x: str) -> str:
    """Normal distribution function by the density times a series of positive terms x^(2n+1) / (1 * 3 * ... * (2n+1))."""
    term = "exp((2 * n + 1) * ln(abs({x})) - lgamma(2 * n + 2) + lgamma(n + 1) + n * ln(2.0))".replace("{x}", x)
    series = f"exp(-{x} * {x} / 2.0) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 120), lambda n: {term}))"
    return f"CASE WHEN {x} = 0 THEN 0.5 WHEN {x} > 9 THEN 1.0 WHEN {x} < -9 THEN 0.0 ELSE 0.5 + sign({x}) * {series} END"


def horner(x: str, coefficients) -> str:
    value = repr(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        value = f"(({value}) * ({x}) + {c!r})"
    return value


def normal_quantile(p: str) -> str:
    q = f"({p} - 0.5)"
    near = f"(0.180625 - {q} * {q})"
    root = f"sqrt(-ln(least({p}, 1 - {p})))"
    centre = f"{q} * {horner(near, CENTRE_TOP)} / {horner(near, CENTRE_BOTTOM)}"
    middle = f"{horner(f'({root} - 1.6)', MIDDLE_TOP)} / {horner(f'({root} - 1.6)', MIDDLE_BOTTOM)}"
    return f"CASE WHEN abs({q}) <= 0.425 THEN {centre} ELSE sign({q}) * {middle} END"


def box(source: str, value: str, by: str) -> str:
    """Statistics and outliers CTEs ``box_stats`` and ``box_out`` of a source CTE."""
    return f"""
bx AS (
  SELECT {by} AS g, COUNT(*) AS n, quantile_cont({value}, 0.25) AS q1, quantile_cont({value}, 0.5) AS median,
         quantile_cont({value}, 0.75) AS q3
  FROM {source} WHERE {value} IS NOT NULL GROUP BY {by}),
placed AS (
  SELECT bx.*, s.{value} AS v,
         s.{value} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside
  FROM {source} s JOIN bx ON bx.g IS NOT DISTINCT FROM s.{by} WHERE s.{value} IS NOT NULL),
box_stats AS (
  SELECT g AS {by}, n, q1, median, q3, MIN(CASE WHEN inside THEN v END) AS whisker_low,
         MAX(CASE WHEN inside THEN v END) AS whisker_high,
         CAST(SUM(CASE WHEN inside THEN 0 ELSE 1 END) AS BIGINT) AS n_outliers
  FROM placed GROUP BY g, n, q1, median, q3),
box_out AS (SELECT g AS {by}, v AS {value}, COUNT(*) AS n FROM placed WHERE NOT inside GROUP BY g, v)"""


BOX_COLUMNS = f"n, {rr('q1', 'median', 'q3', 'whisker_low', 'whisker_high')}, n_outliers"


def mid_rank(value: str, by: str = "") -> str:
    part = f"PARTITION BY {by}" if by else ""
    ties = f"PARTITION BY {by + ', ' if by else ''}{value}"
    return f"(rank() OVER ({part} ORDER BY {value}) + (COUNT(*) OVER ({ties}) - 1) / 2.0)"


def association(source: str, by: str) -> str:
    """Rank correlation of growth and grade per group with p-value and texts, as CTE ``assoc``."""
    t = "rho * sqrt((n - 2) / NULLIF(1 - rho * rho, 0))"
    return f"""
ranked AS (
  SELECT {by}, growth_pct, grade, {mid_rank("growth_pct", by)} AS rx, {mid_rank("grade", by)} AS ry FROM {source}),
cor AS (
  SELECT {by}, COUNT(*) AS n,
         covar_pop(rx, ry) / NULLIF(sqrt(var_pop(rx)) * sqrt(var_pop(ry)), 0) AS rho,
         AVG(CASE WHEN grade = 1 THEN growth_pct END) AS mean_1,
         AVG(CASE WHEN grade = 2 THEN growth_pct END) AS mean_2,
         AVG(CASE WHEN grade = 3 THEN growth_pct END) AS mean_3
  FROM ranked GROUP BY {by}),
tested AS (SELECT *, abs(rho) >= 1 - 1e-12 AS exact, CASE WHEN n > 2 AND abs(rho) < 1 - 1e-12 THEN {t} END AS t FROM cor),
valued AS (SELECT *, CASE WHEN n > 2 AND exact THEN 0.0 ELSE {student_p("t", "n - 2")} END AS p_value FROM tested),
assoc AS (
  SELECT *,
    CASE WHEN p_value < 0.05 AND rho < 0 THEN '{labels.RELATION_GOOD}'
         WHEN p_value < 0.05 AND rho > 0 THEN '{labels.RELATION_BAD}' ELSE '{labels.RELATION_WEAK}' END AS relation,
    CASE WHEN p_value IS NULL THEN '{labels.TEXT_UNDEFINED}' WHEN p_value >= 0.05 THEN '{labels.TEXT_NO_LINK}'
         WHEN rho < 0 THEN '{labels.TEXT_EXPECTED}' WHEN rho > 0 THEN '{labels.TEXT_REVERSED}'
         ELSE '{labels.TEXT_OTHER}' END AS interpretation
  FROM valued)"""


ASSOC_COLUMNS = f"n, {rr('rho', 'p_value', 'mean_1', 'mean_2', 'mean_3')}, relation, interpretation"


def factor_model(source: str, y: str) -> str:
    """Least squares of y on the grade by the textbook sums, as CTE ``coef``."""
    return f"""
y AS (SELECT {y} AS y, grade FROM {source}),
lev AS (SELECT grade, COUNT(*) AS n, AVG(y) AS m FROM y GROUP BY grade),
res AS (
  SELECT SUM((y.y - lev.m) * (y.y - lev.m)) AS ssw, COUNT(*) AS n, COUNT(DISTINCT y.grade) AS k
  FROM y JOIN lev ON lev.grade = y.grade),
tots AS (SELECT SUM((y.y - g.m) * (y.y - g.m)) AS sst FROM y CROSS JOIN (SELECT AVG(y) AS m FROM y) g),
base AS (SELECT * FROM lev WHERE grade = (SELECT MIN(grade) FROM lev)),
coef0 AS (
  SELECT CASE WHEN lev.grade = base.grade THEN '(Intercept)' ELSE CAST(lev.grade AS VARCHAR) END AS term,
         CASE WHEN lev.grade = base.grade THEN lev.m ELSE lev.m - base.m END AS estimate,
         sqrt(ssw / (res.n - res.k) * (1.0 / lev.n + CASE WHEN lev.grade = base.grade THEN 0 ELSE 1.0 / base.n END)) AS std_error,
         1 - ssw / sst AS r_squared, sqrt(ssw / (res.n - res.k)) AS sigma, res.n - res.k AS df_resid,
         res.k AS k, ssw, sst
  FROM lev CROSS JOIN base CROSS JOIN res CROSS JOIN tots),
coef1 AS (SELECT *, estimate / NULLIF(std_error, 0) AS t_value FROM coef0),
coef AS (SELECT *, {student_p("t_value", "df_resid")} AS p_value FROM coef1)"""


COEF = f"term, {rr('estimate', 'std_error', 'sigma')}, df_resid, {rr('t_value', 'p_value')}"

RANKED = f"""{ANALYSED},
rk AS (SELECT grade, growth_pct, {mid_rank("growth_pct")} AS rnk FROM growths),
lev AS (SELECT grade, COUNT(*) AS n, SUM(rnk) AS rs, AVG(rnk) AS mr FROM rk GROUP BY grade),
tie AS (SELECT SUM(c * c * c - c) AS ties FROM (SELECT CAST(COUNT(*) AS DOUBLE) AS c FROM growths GROUP BY growth_pct) q),
al AS (SELECT CAST(COUNT(*) AS DOUBLE) AS n FROM growths)"""

TUKEY = f"""{ANALYSED},{factor_model("growths", "growth_pct")}"""


def bits(x: str) -> str:
    """The lowest 64 bits of a wide number."""
    return f"CAST(({x}) % 18446744073709551616 AS UBIGINT)"


def bootstrap() -> str:
    side = {"mono": labels.MONO, "pluri": labels.PLURI}
    by = "species, stand_type, iteration"
    return f"""{ANALYSED},
ok AS (
  SELECT species FROM growths GROUP BY species
  HAVING COUNT(CASE WHEN stand_type = '{side["mono"]}' THEN 1 END) >= 10
     AND COUNT(CASE WHEN stand_type = '{side["pluri"]}' THEN 1 END) >= 10),
num AS (
  SELECT species, stand_type, growth_pct, grade,
         row_number() OVER (PARTITION BY species, stand_type ORDER BY growth_pct, grade) AS rn,
         COUNT(*) OVER (PARTITION BY species, stand_type) AS gs
  FROM growths WHERE species IN (SELECT species FROM ok)),
seed AS (
  SELECT species, stand_type, CAST(iteration AS INT) AS iteration,
         CAST(CAST('0x' || substr(md5(concat_ws('|', '{BOOT_SEED}', species, stand_type, CAST(iteration AS VARCHAR), '0')), 1, 16)
              AS UBIGINT) AS UHUGEINT) AS s
  FROM (SELECT DISTINCT species, stand_type FROM num) CROSS JOIN range(1, {BOOT_ITER + 1}) t(iteration)),
h0 AS (
  SELECT n.species, n.stand_type, iteration, gs, {bits("s + CAST(rn AS UHUGEINT) * 11400714819323198485")} AS x
  FROM num n JOIN seed d ON d.species = n.species AND d.stand_type = n.stand_type),
h1 AS (SELECT * REPLACE ({bits("CAST(xor(x, x >> 30) AS UHUGEINT) * 13787848793156543929")} AS x) FROM h0),
h2 AS (SELECT * REPLACE ({bits("CAST(xor(x, x >> 27) AS UHUGEINT) * 10723151780598845931")} AS x) FROM h1),
draw AS (SELECT species, stand_type, iteration, CAST(xor(x, x >> 31) % CAST(gs AS UBIGINT) AS BIGINT) + 1 AS pick FROM h2),
got AS (
  SELECT d.species, d.stand_type, d.iteration, n.growth_pct, n.grade
  FROM draw d JOIN num n ON n.species = d.species AND n.stand_type = d.stand_type AND n.rn = d.pick),
ranked AS (
  SELECT {by}, {mid_rank("growth_pct", by)} AS rx, {mid_rank("grade", by)} AS ry FROM got),
rho AS (
  SELECT {by}, covar_pop(rx, ry) / NULLIF(sqrt(var_pop(rx)) * sqrt(var_pop(ry)), 0) AS rho FROM ranked GROUP BY {by}),
boot AS (
  SELECT species, iteration, MAX(CASE WHEN stand_type = '{side["mono"]}' THEN rho END)
       - MAX(CASE WHEN stand_type = '{side["pluri"]}' THEN rho END) AS diff
  FROM rho GROUP BY species, iteration)"""


RING = [(-4.5, 48.5), (2.5, 51.0), (8.0, 49.0), (7.0, 43.5), (3.0, 42.5), (-1.5, 43.3)]


REGIONS = {
    "area": [RING],
    "north": [[(-6.0, 46.2), (9.5, 46.2), (9.5, 52.0), (-6.0, 52.0)]],
    "ringed": [[(-2.0, 43.0), (6.0, 44.0), (5.0, 50.0), (-3.0, 49.0)], [(0.0, 45.0), (3.0, 45.0), (3.0, 47.5), (0.0, 47.5)]],
    "islands": [[(-5.0, 41.0), (-4.0, 41.0), (-4.5, 42.0)], [(7.0, 41.0), (9.4, 41.2), (8.0, 43.1)]],
}


def inside_ring(lon: str = "lon", lat: str = "lat", rings=(RING,)) -> str:
    """Even-odd rule, one edge after another; level edges are never crossed."""
    tests = []
    for (x1, y1), (x2, y2) in (e for ring in rings for e in zip(ring, ring[1:] + ring[:1]) if e[0][1] != e[1][1]):
        tests.append(
            f"CASE WHEN ({y1} > {lat}) <> ({y2} > {lat}) AND {lon} < {x1} + ({lat} - {y1}) * ({x2 - x1}) / ({y2 - y1}) "
            "THEN 1 ELSE 0 END"
        )
    return f"{lon} IS NOT NULL AND {lat} IS NOT NULL AND ({' + '.join(tests)}) % 2 = 1"


def colours(table: dict[str, str], column: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"


def layer(measure: str, label: str | None, table: dict[str, str] | None, needed: str) -> str:
    return (
        f"WITH {METRICS} SELECT met.plot, species, {r('lon')}, {r('lat')}, {r(measure, 'measure')}, "
        f"{label or 'CAST(NULL AS VARCHAR)'} AS class, "
        f"{colours(table, label) if table else 'CAST(NULL AS VARCHAR)'} AS colour "
        f"FROM met JOIN site ON site.plot = met.plot WHERE lon IS NOT NULL AND lat IS NOT NULL AND {needed} IS NOT NULL"
    )


def statements() -> dict[str, str]:
    indicators = rr("ini", "fin", "evol", "total_ini", "total_fin", "growth_pct", "share_shift")
    smooth = f"{PANEL},{indicator_ctes(fin=SMOOTH)}"
    latin = "'Species_' || substr(species, 7)"
    wide = ", ".join(f"MAX(CASE WHEN species = '{b}' THEN value END) AS \"{b}\"" for b in BRANDS)
    wide_rounded = ", ".join(r(f'"{b}"') for b in BRANDS)
    wide_total = " + ".join(f'COALESCE("{b}", 0)' for b in BRANDS)
    wide_cte = f"wide AS (SELECT plot, year, {wide} FROM cell WHERE scenario = 'N' GROUP BY plot, year)"
    site_columns = f"greco, ser, {rr('alt', 'lon', 'lat')}"

    q = {}
    q["two_date_indicators"] = f"WITH {PANEL},{IND} SELECT plot, species, {indicators} FROM ind"
    sparse_fin = "MAX(CASE WHEN year = 2001 THEN value END)"
    q["two_date_indicators_sparse"] = f"""WITH {PANEL},
two AS (SELECT plot, species, MAX(CASE WHEN year = 1995 THEN value END) AS ini, {sparse_fin} AS fin
        FROM cell WHERE scenario = 'N' AND year IN (1995, 2001) GROUP BY plot, species),
tot AS (SELECT *, COALESCE(SUM(ini) OVER (PARTITION BY plot), 0) AS total_ini,
               COALESCE(SUM(fin) OVER (PARTITION BY plot), 0) AS total_fin FROM two),
ind AS (SELECT *, fin - ini AS evol, CASE WHEN ini > 0 THEN fin * 100 / ini - 100 END AS growth_pct,
               fin * 100 / NULLIF(total_fin, 0) - ini * 100 / NULLIF(total_ini, 0) AS share_shift
        FROM tot WHERE NOT (ini = 0 AND fin = 0))
SELECT plot, species, {indicators} FROM ind"""
    q["smoothed_indicators"] = (
        f"WITH {smooth} SELECT plot, species, {rr('ini', 'fin', 'growth_pct', 'share_shift')}, stand_type FROM ind"
    )
    q["smoothed_indicators_sparse"] = f"""WITH {PANEL},
s AS (SELECT plot, species, value AS ini FROM cell WHERE scenario = 'N' AND year = 1995),
t AS (SELECT plot, species, AVG(value) AS fin FROM cell WHERE scenario = 'N' AND year BETWEEN 1999 AND 2001
      GROUP BY plot, species)
SELECT s.plot, s.species, {rr('ini', 'fin')} FROM s LEFT JOIN t ON t.plot = s.plot AND t.species = s.species"""
    q["grade_lookup"] = (
        f"WITH {PANEL},{IND},{GRADE} SELECT i.plot, i.species, g.grade, 'Species_' || substr(i.species, 7) AS species_latin "
        "FROM ind i LEFT JOIN grade g ON g.plot = i.plot AND g.species = i.species"
    )
    q["grade_left_join"] = f"""WITH {PANEL},{IND},{GRADE}
SELECT i.plot, i.species, {r('growth_pct')}, CASE WHEN fin > 0 THEN g.grade END AS grade
FROM ind i LEFT JOIN grade g ON g.plot = i.plot AND g.species = i.species"""
    q["stand_type"] = (
        f"WITH {PANEL},{IND} SELECT plot, stand_type, {r('MAX(max_share)', 'max_share')} FROM ind GROUP BY plot, stand_type"
    )
    table = f"{indicators}, {r('max_share')}, stand_type, {site_columns}, g.grade"
    joined = """FROM ind i JOIN site s ON s.plot = i.plot
LEFT JOIN grade g ON g.plot = i.plot AND g.species = i.species"""
    q["analysis_table"] = (
        f"WITH {PANEL},{IND},{GRADE},{SITE} SELECT i.plot, i.species, {table}, "
        f"'Species_' || substr(i.species, 7) AS species_latin {joined}"
    )
    # Grades of the smoothed table come from plots and species present at one of the two dates.
    q["analysis_table_smoothed"] = f"""WITH {smooth},{GRADE},{SITE},
here AS (SELECT DISTINCT plot, species FROM panel WHERE scenario = 'N' AND year IN (1995, 2001) AND value <> 0)
SELECT i.plot, i.species, {table} FROM ind i JOIN site s ON s.plot = i.plot
LEFT JOIN (SELECT grade.* FROM grade JOIN here ON here.plot = grade.plot AND here.species = grade.species) g
       ON g.plot = i.plot AND g.species = i.species"""
    q["drop_all_zero_groups"] = f"""WITH {METRICS}
SELECT plot, scenario, species, year, {r('value')} FROM held"""
    q["densify_panel"] = f"WITH {PANEL} SELECT plot, scenario, species, year, {r('value')} FROM panel"
    q["share_composition"] = f"""WITH {SHARES}
SELECT plot, species, year, {rr('value', 'total', 'share')} FROM sh WHERE value > 0"""
    q["share_ratio_diff"] = f"""WITH {SHARES}
SELECT plot, species, {rr('share_start', 'share_end')}, {r('share_end / NULLIF(share_start, 0)', 'share_ratio')},
       {r('share_end - share_start', 'share_diff')} FROM sc"""
    q["trailing_ratio"] = f"""WITH {SHARES}
SELECT plot, species, {rr('share_end', 'share_before')}, {r('share_end / NULLIF(share_before, 0)', 'trailing_ratio')} FROM sc"""
    q["trailing_ratio_all_dates"] = f"""WITH {SHARES}
SELECT a.plot, a.species, a.year, {r('a.share', 'now')}, {r('b.share', 'before')}, {r('a.share / NULLIF(b.share, 0)', 'ratio')}
FROM sh a JOIN sh b ON b.plot = a.plot AND b.species = a.species AND b.year = a.year - 3
WHERE a.value > 0 AND b.value > 0"""
    q["evolution_from_shares"] = f"""WITH {SHARES}
SELECT plot, species, CASE WHEN share_start > 0.1 AND share_end < 0.01 THEN 'disp'
  WHEN share_end > 0.1 AND share_end > share_start THEN 'exp'
  WHEN share_start > 0.1 AND share_end < share_start AND share_end > 0.01 THEN 'declin' END AS evolution FROM sc"""
    q["evolution_from_growth"] = (
        f"WITH {ANALYSED} SELECT plot, species, {r('growth_pct')}, evolution FROM ana"
    )
    q["change_metrics"] = f"""WITH {METRICS}
SELECT plot, species, {rr('start_value', 'end_value', 'total_start', 'total_end', 'diff_abs', 'pct_loss', 'pct_appear', 'pct_growth')}
FROM met"""
    q["loss_appear_classes"] = (
        f"WITH {METRICS} SELECT plot, species, {rr('pct_loss', 'pct_appear')}, loss_class, appear_class FROM met"
    )
    q["presence_absence"] = f"WITH {METRICS} SELECT plot, species, {r('end_value')}, presence FROM met"
    q["presence_likelihood"] = f"WITH {METRICS} SELECT plot, species, presence, likelihood FROM met"
    q["agreement_flag"] = f"WITH {ANALYSED} SELECT plot, species, evolution, grade, agreement FROM judged"
    q["contingency"] = f"""WITH {ANALYSED}
SELECT grade, COUNT(CASE WHEN evolution = 'disp' THEN 1 END) AS disp, COUNT(CASE WHEN evolution = 'exp' THEN 1 END) AS exp,
       COUNT(CASE WHEN evolution = 'declin' THEN 1 END) AS declin
FROM judged WHERE grade IS NOT NULL AND evolution IS NOT NULL GROUP BY grade"""
    q["contingency_shares"] = f"""WITH {ANALYSED},
c AS (SELECT grade, evolution, COUNT(*) AS n FROM judged
      WHERE grade IS NOT NULL AND evolution IS NOT NULL GROUP BY grade, evolution)
SELECT grade, evolution, n, {r('n / (SELECT SUM(d.n) FROM c d WHERE d.grade = c.grade)', 'row_share')} FROM c"""
    q["species_totals"] = (
        f"WITH {PANEL} SELECT species, {r('SUM(value)', 'total')} FROM cell WHERE scenario = 'N' GROUP BY species"
    )
    q["site_left_join"] = f"""WITH {PANEL},{SITE},
t AS (SELECT plot, scenario, year, SUM(value) AS total FROM cell WHERE scenario = 'N' GROUP BY plot, scenario, year)
SELECT t.plot, t.scenario, t.year, {r('total')}, {site_columns} FROM t LEFT JOIN site ON site.plot = t.plot"""
    q["null_safe_totals_join"] = f"""WITH {PANEL},{SITE},
d AS (SELECT c.*, lon, lat FROM cell c LEFT JOIN site ON site.plot = c.plot WHERE scenario = 'N' AND year IN (1995, 2001)),
p AS (SELECT plot, scenario, lon, lat, species, COALESCE(SUM(CASE WHEN year = 1995 THEN value END), 0) AS start_value,
             COALESCE(SUM(CASE WHEN year = 2001 THEN value END), 0) AS end_value
      FROM d GROUP BY plot, scenario, lon, lat, species),
t AS (SELECT plot, scenario, lon, lat, SUM(CASE WHEN year = 1995 THEN value END) AS total_start,
             SUM(CASE WHEN year = 2001 THEN value END) AS total_end FROM d GROUP BY plot, scenario, lon, lat)
SELECT p.plot, p.scenario, {r('p.lon', 'lon')}, {r('p.lat', 'lat')}, species,
       {rr('start_value', 'end_value', 'total_start', 'total_end')}
FROM p LEFT JOIN t ON t.plot = p.plot AND t.scenario = p.scenario AND t.lon IS NOT DISTINCT FROM p.lon
                  AND t.lat IS NOT DISTINCT FROM p.lat"""
    q["species_wide"] = (
        f"WITH {PANEL},{wide_cte} SELECT plot, year, {wide_rounded}, {r(wide_total, 'total')} FROM wide"
    )
    q["species_long"] = f"""WITH {PANEL}
SELECT k.plot, k.year, s.species, {r('c.value', 'value')}
FROM (SELECT DISTINCT plot, year FROM cell WHERE scenario = 'N') k
CROSS JOIN (SELECT DISTINCT p_brand AS species FROM part) s
LEFT JOIN cell c ON c.scenario = 'N' AND c.plot = k.plot AND c.year = k.year AND c.species = s.species"""
    q["belt_lookup"] = f"""WITH {PANEL},{IND},{BELT}
SELECT plot, ind.species, belt, stand_type, {r('growth_pct')} FROM ind JOIN belt ON belt.species = ind.species"""
    q["cross_model_pairs"] = f"WITH {MODELS} SELECT plot, species_latin, {rr('value_m', 'value_p')} FROM pairs"
    q["cross_model_means"] = f"""WITH {MODELS},
a AS (SELECT species, AVG(growth_pct) AS value_m FROM im GROUP BY species),
b AS (SELECT species, AVG(growth_pct) AS value_p FROM ip GROUP BY species)
SELECT 'Species_' || substr(a.species, 7) AS species_latin, {rr('value_m', 'value_p')} FROM a JOIN b ON a.species = b.species"""
    q["complete_rows"] = q["two_date_indicators_sparse"] + (
        " WHERE ini IS NOT NULL AND fin IS NOT NULL AND growth_pct IS NOT NULL AND share_shift IS NOT NULL"
    )
    q["stacked_models"] = f"""WITH {MODELS}
SELECT plot, species, {rr('ini', 'fin', 'growth_pct')}, 'M' AS model FROM im UNION ALL
SELECT plot, species, {rr('ini', 'fin', 'growth_pct')}, 'P' AS model FROM ip"""
    q["distinct_species"] = f"WITH {PANEL} SELECT DISTINCT species FROM cell"
    q["level_codes"] = f"""WITH {PANEL},{IND}
SELECT stand_type, CAST(dense_rank() OVER (ORDER BY stand_type) AS INT) AS stand_type_code, COUNT(*) AS n
FROM ind GROUP BY stand_type"""
    profile = """COUNT(*) FILTER ({v} IS NULL) AS n_missing, COUNT({v}) AS n, """.replace("FILTER (", "FILTER (WHERE ")
    numbers = lambda v: profile.format(v=v) + ", ".join(
        [
            r(f"MIN({v})", "min"), r(f"quantile_cont({v}, 0.25)", "q1"), r(f"quantile_cont({v}, 0.5)", "median"),
            r(f"AVG({v})", "mean"), r(f"quantile_cont({v}, 0.75)", "q3"), r(f"MAX({v})", "max"),
        ]
    )
    q["numeric_profile"] = f"""WITH {PANEL},
t AS (SELECT plot, scenario, year, SUM(value) AS total FROM cell GROUP BY plot, scenario, year)
SELECT scenario, {numbers('total')} FROM t GROUP BY scenario"""
    q["numeric_profile_growth"] = f"WITH {PANEL},{IND} SELECT {numbers('growth_pct')} FROM ind"
    q["large_totals"] = f"""WITH {PANEL},
t AS (SELECT plot, scenario, year, SUM(value) AS total FROM cell GROUP BY plot, scenario, year)
SELECT plot, scenario, year, {r('total')} FROM t WHERE total > 80 AND year = 1995"""
    q["category_frequency"] = f"WITH {ANALYSED} SELECT evolution, COUNT(*) AS n FROM ana GROUP BY evolution"
    q["agreement_frequency"] = f"WITH {ANALYSED} SELECT agreement, COUNT(*) AS n FROM judged GROUP BY agreement"
    q["boxplot_stats"] = f"WITH {ANALYSED},{box('ana', 'growth_pct', 'grade')} SELECT grade, {BOX_COLUMNS} FROM box_stats"
    q["boxplot_outliers"] = (
        f"WITH {ANALYSED},{box('ana', 'growth_pct', 'grade')} SELECT grade, {r('growth_pct')}, n FROM box_out"
    )
    clipped = "clipped AS (SELECT * FROM ana WHERE growth_pct BETWEEN -100 AND 100)"
    q["boxplot_stats_clipped"] = (
        f"WITH {ANALYSED},{clipped},{box('clipped', 'growth_pct', 'grade')} SELECT grade, {BOX_COLUMNS} FROM box_stats"
    )
    q["distribution_by_year"] = (
        f"WITH {PANEL}, cn AS (SELECT * FROM cell WHERE scenario = 'N'),{box('cn', 'value', 'year')} "
        f"SELECT year, {BOX_COLUMNS} FROM box_stats"
    )
    q["top_n_ties"] = f"""WITH {PANEL},{IND}
SELECT plot, species, {r('growth_pct')} FROM ind QUALIFY rank() OVER (ORDER BY growth_pct DESC NULLS LAST) <= 10"""
    q["sample_n"] = f"""WITH {PANEL},{IND}
SELECT plot, species, {r('growth_pct')} FROM ind
ORDER BY md5(concat_ws('|', '1', CAST(plot AS VARCHAR), species)), plot, species LIMIT 500"""
    q["quantiles"] = f"""WITH {PANEL},{IND}
SELECT stand_type, COUNT(growth_pct) AS n, {r('quantile_cont(growth_pct, 0.025)', 'q025')},
       {r('quantile_cont(growth_pct, 0.975)', 'q975')} FROM ind GROUP BY stand_type"""
    q["mid_ranks"] = f"""WITH {PANEL},{IND},
k AS (SELECT plot, species, {mid_rank('growth_pct', 'stand_type')} AS rank FROM ind WHERE growth_pct IS NOT NULL)
SELECT ind.plot, ind.species, stand_type, {r('growth_pct')}, {r('k.rank', 'rank')}
FROM ind LEFT JOIN k ON k.plot = ind.plot AND k.species = ind.species"""
    belted = "belted AS (SELECT g.*, belt FROM growths g JOIN belt ON belt.species = g.species)"
    q["spearman_by_group"] = (
        f"WITH {ANALYSED},{BELT},{belted},{association('belted', 'belt, stand_type')} "
        f"SELECT belt, stand_type, {ASSOC_COLUMNS} FROM assoc"
    )
    q["spearman_by_species"] = (
        f"WITH {ANALYSED},{association('growths', 'species, stand_type')} "
        f"SELECT species, stand_type, {ASSOC_COLUMNS} FROM assoc"
    )
    q["grade_means"] = f"""WITH {ANALYSED}
SELECT stand_type, {', '.join(r(f'AVG(CASE WHEN grade = {g} THEN growth_pct END)', f'mean_{g}') for g in (1, 2, 3))},
       COUNT(*) AS n FROM growths GROUP BY stand_type"""
    q["ols_categorical"] = (
        f"WITH {ANALYSED},{factor_model('growths', 'share_shift')} SELECT {COEF}, {r('r_squared')} FROM coef"
    )
    positive = "pos AS (SELECT grade, ln(growth_pct) AS ly FROM growths WHERE growth_pct > 0)"
    q["ols_log"] = (
        f"WITH {ANALYSED},{positive},{factor_model('pos', 'ly')} SELECT {COEF}, {r('r_squared')}, "
        "(SELECT COUNT(*) FROM growths WHERE growth_pct <= 0) AS n_dropped FROM coef"
    )
    ratio = "lr AS (SELECT grade, ln(fin) - ln(ini) AS ly FROM growths WHERE fin > 0 AND ini > 0)"
    q["ols_offset"] = f"WITH {ANALYSED},{ratio},{factor_model('lr', 'ly')} SELECT {COEF} FROM coef"
    q["ols_pair"] = f"""WITH {MODELS},
kn AS (SELECT * FROM pairs WHERE value_m IS NOT NULL AND value_p IS NOT NULL),
s AS (SELECT COUNT(*) AS n, regr_slope(value_m, value_p) AS slope, regr_intercept(value_m, value_p) AS intercept,
             regr_r2(value_m, value_p) AS r_squared, regr_sxx(value_m, value_p) AS sxx, regr_syy(value_m, value_p) AS syy,
             regr_sxy(value_m, value_p) AS sxy, AVG(value_p) AS mx FROM kn),
e AS (SELECT *, sqrt((syy - slope * sxy) / (n - 2)) AS sigma FROM s),
f AS (SELECT *, sigma / sqrt(sxx) AS slope_se, sigma * sqrt(1.0 / n + mx * mx / sxx) AS intercept_se FROM e),
g AS (SELECT *, slope / slope_se AS slope_t, intercept / intercept_se AS intercept_t FROM f)
SELECT n, {rr('slope', 'intercept', 'r_squared', 'sigma', 'slope_se', 'intercept_se', 'slope_t', 'intercept_t')},
       {r(student_p('slope_t', 'n - 2'), 'slope_p')}, {r(student_p('intercept_t', 'n - 2'), 'intercept_p')} FROM g"""
    # With two degrees of freedom between levels the upper tail of F has a closed form.
    q["anova_oneway"] = f"""WITH {ANALYSED},{factor_model('growths', 'growth_pct')},
o AS (SELECT DISTINCT k - 1 AS df_between, df_resid AS df_within, sst - ssw AS ss_between, ssw AS ss_within FROM coef),
m AS (SELECT *, ss_between / df_between AS ms_between, ss_within / df_within AS ms_within FROM o),
f AS (SELECT *, ms_between / ms_within AS f_value FROM m)
SELECT df_between, df_within, {', '.join(r(c, digits=3) for c in ('ss_between', 'ss_within', 'ms_between', 'ms_within'))},
       {r('f_value')}, {r('pow(df_within / (df_within + 2 * f_value), df_within / 2.0)', 'p_value')} FROM f"""
    q["tukey_pairs"] = f"""WITH {TUKEY},
e AS (SELECT DISTINCT df_resid AS df, ssw / df_resid AS msw FROM coef)
SELECT a.grade AS level_a, b.grade AS level_b, {r('b.m - a.m', 'diff')},
       {r('abs(b.m - a.m) / sqrt(msw / 2 * (1.0 / a.n + 1.0 / b.n))', 'q')}, df
FROM lev a JOIN lev b ON a.grade < b.grade CROSS JOIN e"""
    # Studentized range of three means by two nested sums of smooth, fast falling functions on even grids; its quantile by bisection.
    inner = f"3 * wz * pow(uz - {below_normal('(z - {q} * s)')}, 2)"
    q["tukey_intervals"] = f"""WITH RECURSIVE {TUKEY},
e AS (SELECT DISTINCT df_resid AS df, ssw / df_resid AS msw FROM coef),
pr AS (
  SELECT a.grade AS level_a, b.grade AS level_b, b.m - a.m AS diff, sqrt(msw / 2 * (1.0 / a.n + 1.0 / b.n)) AS scale, df
  FROM lev a JOIN lev b ON a.grade < b.grade CROSS JOIN e),
gs0 AS (SELECT df, 1 + i / 3.0 / sqrt(2.0 * df) AS s FROM e CROSS JOIN range(-27, 28) t(i)),
gs AS (SELECT s, exp((df - 1) * ln(s) - df * (s * s - 1) / 2.0) AS ws FROM gs0 WHERE s > 0),
gz AS (SELECT z, 0.2 * exp(-z * z / 2.0) / sqrt(2 * pi()) AS wz, {below_normal('z')} AS uz
       FROM (SELECT i / 5.0 AS z FROM range(-45, 46) t(i)) g),
grid AS (SELECT s, z, wz, uz, ws / (SELECT SUM(ws) FROM gs) AS ws FROM gs CROSS JOIN gz),
bis AS (
  SELECT 0 AS i, CAST(0 AS DOUBLE) AS lo, CAST(64 AS DOUBLE) AS hi
  UNION ALL
  SELECT i + 1, CASE WHEN inside < 0.95 THEN mid ELSE lo END, CASE WHEN inside < 0.95 THEN hi ELSE mid END
  FROM (SELECT i, lo, hi, mid, SUM(ws * {inner.format(q='mid')}) AS inside
        FROM (SELECT *, (lo + hi) / 2 AS mid FROM bis WHERE i < 54) b CROSS JOIN grid GROUP BY i, lo, hi, mid) t),
point AS (SELECT (lo + hi) / 2 AS half FROM bis WHERE i = 54),
tested AS (
  SELECT level_a, level_b, greatest(0.0, 1 - SUM(ws * {inner.format(q='(abs(diff) / scale)')})) AS p_adjusted
  FROM pr CROSS JOIN grid GROUP BY level_a, level_b)
SELECT pr.level_a, pr.level_b, {r('diff')}, {r('abs(diff) / scale', 'q')}, df, {r('p_adjusted')},
       {r('diff - half * scale', 'ci_lower')}, {r('diff + half * scale', 'ci_upper')}
FROM pr JOIN tested t ON t.level_a = pr.level_a AND t.level_b = pr.level_b CROSS JOIN point"""
    q["kruskal"] = f"""WITH {RANKED},
h AS (SELECT CAST(al.n AS BIGINT) AS n,
             (12 / (al.n * (al.n + 1)) * (SELECT SUM(rs * rs / n) FROM lev) - 3 * (al.n + 1))
             / (1 - ties / (al.n * al.n * al.n - al.n)) AS h,
             CAST((SELECT COUNT(*) FROM lev) - 1 AS INT) AS df FROM al CROSS JOIN tie)
SELECT n, {r('h')}, df, {r('exp(-h / 2)', 'p_value')} FROM h"""
    q["dunn_bh"] = f"""WITH {RANKED},
z AS (SELECT a.grade AS level_a, b.grade AS level_b,
             (a.mr - b.mr) / sqrt((al.n * (al.n + 1) / 12 - ties / (12 * (al.n - 1))) * (1.0 / a.n + 1.0 / b.n)) AS z
      FROM lev a JOIN lev b ON a.grade < b.grade CROSS JOIN al CROSS JOIN tie),
p AS (SELECT *, {normal_p('z')} AS p_value FROM z),
s AS (SELECT *, p_value * COUNT(*) OVER () / row_number() OVER (ORDER BY p_value) AS step FROM p)
SELECT level_a, level_b, {rr('z', 'p_value')},
       {r('least(1.0, (SELECT MIN(t.step) FROM s t WHERE t.p_value >= s.p_value))', 'p_adjusted')} FROM s"""
    # Ranking inside each pair, W from the rank sum of the first level.
    q["wilcoxon_pairs"] = f"""WITH {ANALYSED},
pr AS (SELECT a.grade AS level_a, b.grade AS level_b FROM (SELECT DISTINCT grade FROM growths) a
       JOIN (SELECT DISTINCT grade FROM growths) b ON a.grade < b.grade),
pg AS (SELECT level_a, level_b, g.grade, growth_pct, {mid_rank('growth_pct', 'level_a, level_b')} AS rnk,
              COUNT(*) OVER (PARTITION BY level_a, level_b, growth_pct) AS c
       FROM pr JOIN growths g ON g.grade IN (level_a, level_b)),
w AS (SELECT level_a, level_b, COUNT(CASE WHEN grade = level_a THEN 1 END) AS n_a,
             COUNT(CASE WHEN grade = level_b THEN 1 END) AS n_b,
             SUM(CASE WHEN grade = level_a THEN rnk END) AS ra, SUM(CAST(c AS DOUBLE) * c - 1) AS ties
      FROM pg GROUP BY level_a, level_b),
v AS (SELECT *, ra - n_a * (n_a + 1) / 2.0 AS w FROM w),
z AS (SELECT *, (w - n_a * n_b / 2.0 - sign(w - n_a * n_b / 2.0) * 0.5)
             / sqrt(CAST(n_a AS DOUBLE) * n_b / 12 * (n_a + n_b + 1 - ties / (CAST(n_a + n_b AS DOUBLE) * (n_a + n_b - 1)))) AS z FROM v)
SELECT level_a, level_b, n_a, n_b, {rr('w', 'z')}, {r(normal_p('z'), 'p_value')} FROM z"""
    q["jarque_bera"] = f"""WITH {PANEL},{IND},
c AS (SELECT share_shift - AVG(share_shift) OVER () AS d FROM ind WHERE share_shift IS NOT NULL),
m AS (SELECT COUNT(*) AS n, AVG(d * d) AS m2, AVG(d * d * d) AS m3, AVG(d * d * d * d) AS m4 FROM c),
k AS (SELECT n, m3 / pow(m2, 1.5) AS skewness, m4 / (m2 * m2) - 3 AS excess_kurtosis FROM m),
j AS (SELECT *, n / 6.0 * (skewness * skewness + excess_kurtosis * excess_kurtosis / 4) AS jb FROM k)
SELECT n, {rr('skewness', 'excess_kurtosis', 'jb')}, {r('exp(-jb / 2)', 'p_value')} FROM j"""
    position = "((rk - 0.5) / n)"
    q["lm_diagnostics"] = f"""WITH {ANALYSED},
lev AS (SELECT grade, COUNT(*) AS ln, AVG(growth_pct) AS fitted FROM growths GROUP BY grade),
d AS (SELECT plot, species, g.grade, fitted, growth_pct - fitted AS resid, 1.0 / ln AS leverage
      FROM growths g JOIN lev ON lev.grade = g.grade),
s AS (SELECT *, resid / sqrt((SELECT SUM(resid * resid) / (COUNT(*) - COUNT(DISTINCT grade)) FROM d) * (1 - leverage)) AS std_resid FROM d),
rs AS (SELECT *, round(std_resid, 9) AS key FROM s),
o AS (SELECT *, {mid_rank('key')} AS rk, COUNT(*) OVER () AS n FROM rs)
SELECT plot, species, grade, {rr('fitted', 'resid', 'std_resid', 'leverage')},
       {r('sqrt(abs(std_resid))', 'scale_location')}, {r(normal_quantile(position), 'theoretical')} FROM o"""
    q["lm_pair_diagnostics"] = f"""WITH {MODELS},
kn AS (SELECT * FROM pairs WHERE value_m IS NOT NULL AND value_p IS NOT NULL),
s AS (SELECT COUNT(*) AS n, regr_slope(value_m, value_p) AS b, regr_intercept(value_m, value_p) AS a,
             regr_sxx(value_m, value_p) AS sxx, regr_syy(value_m, value_p) AS syy, regr_sxy(value_m, value_p) AS sxy,
             AVG(value_p) AS mx FROM kn),
d AS (SELECT plot, species_latin, a + b * value_p AS fitted, value_m - a - b * value_p AS resid,
             1.0 / n + (value_p - mx) * (value_p - mx) / sxx AS leverage, sqrt((syy - b * sxy) / (n - 2)) AS sigma
      FROM kn CROSS JOIN s),
e AS (SELECT *, resid / (sigma * sqrt(1 - leverage)) AS std_resid FROM d),
rs AS (SELECT *, round(std_resid, 9) AS key FROM e),
o AS (SELECT *, {mid_rank('key')} AS rk, COUNT(*) OVER () AS n FROM rs)
SELECT plot, species_latin, {rr('fitted', 'resid', 'std_resid', 'leverage')},
       {r('sqrt(abs(std_resid))', 'scale_location')}, {r(normal_quantile(position), 'theoretical')} FROM o"""
    q["bootstrap_rho_diff"] = f"WITH {bootstrap()} SELECT species, iteration, {r('diff')} FROM boot"
    q["bootstrap_ci"] = f"""WITH {bootstrap()},
c AS (SELECT species, AVG(diff) AS mean_diff, quantile_cont(diff, 0.025) AS ci_lower, quantile_cont(diff, 0.975) AS ci_upper
      FROM boot GROUP BY species)
SELECT species, {rr('mean_diff', 'ci_lower', 'ci_upper')}, ci_lower > 0 OR ci_upper < 0 AS significant FROM c"""
    crop = "lon BETWEEN -5.5 AND 9.8 AND lat BETWEEN 41 AND 51.5"
    q["bbox_crop"] = f"WITH {SITE} SELECT plot, {rr('lon', 'lat')} FROM site WHERE {crop}"
    q["unlocated_sites"] = (
        f"WITH {SITE} SELECT COUNT(*) AS n_unlocated FROM site WHERE lon IS NULL OR lat IS NULL"
    )
    q["point_in_polygon"] = (
        f"WITH {SITE} SELECT plot, {rr('lon', 'lat')} FROM site WHERE {crop} AND {inside_ring()}"
    )
    q["clipped_growth"] = (
        f"WITH {PANEL},{IND},{SITE} SELECT ind.plot, species, {r('growth_pct')} FROM ind JOIN site ON site.plot = ind.plot "
        f"WHERE {inside_ring()}"
    )
    q["map_change"] = layer("diff_abs", None, None, "diff_abs")
    q["map_loss"] = layer("pct_loss", "loss_class", labels.LOSS_COLOURS, "pct_loss")
    q["map_appearance"] = layer("pct_appear", "appear_class", labels.APPEAR_COLOURS, "pct_appear")
    q["map_presence"] = layer("end_value", "presence", labels.PRESENCE_COLOURS, "presence")
    q["map_likelihood"] = layer("end_value", "likelihood", labels.LIKELIHOOD_COLOURS, "likelihood")
    q["map_agreement"] = f"""WITH {ANALYSED},{SITE}
SELECT j.plot, species, {rr('lon', 'lat')}, {r('growth_pct', 'measure')}, agreement AS class,
       {colours(labels.AGREEMENT_COLOURS, 'agreement')} AS colour
FROM judged j JOIN site ON site.plot = j.plot WHERE grade <> 1 AND lon IS NOT NULL AND lat IS NOT NULL"""
    q["map_value"] = f"""WITH {PANEL},{SITE}
SELECT c.plot, species, {rr('lon', 'lat')}, {r('value', 'measure')} FROM cell c JOIN site ON site.plot = c.plot
WHERE scenario = 'N' AND year = 2001 AND lon IS NOT NULL AND lat IS NOT NULL"""
    q["series_table"] = (
        f"WITH {PANEL} SELECT plot, species, year, {r('value')} FROM cell WHERE scenario = 'N' ORDER BY plot, species, year"
    )
    q["ordered_bars"] = f"""WITH {PANEL},
t AS (SELECT species, SUM(value) AS total FROM cell WHERE scenario = 'N' GROUP BY species)
SELECT species, {r('total')}, CAST(row_number() OVER (ORDER BY total, species) AS INT) AS sort_key FROM t"""
    label = "CASE WHEN p_value < 0.05 THEN 'ρ=' || regexp_replace(CAST(round_even(rho, 2) AS VARCHAR), '\\.0$', '') ELSE '' END"
    q["correlation_bars"] = (
        f"WITH {ANALYSED},{BELT},{belted},{association('belted', 'belt, stand_type')} "
        f"SELECT belt, stand_type, {r('rho')}, {label} AS label, {colours(labels.RELATION_COLOURS, 'relation')} AS colour, "
        "CAST(row_number() OVER (PARTITION BY belt ORDER BY rho ASC NULLS LAST, stand_type) AS INT) AS sort_key FROM assoc"
    )
    q["picked_bars"] = (
        f"WITH {ANALYSED},{association('growths', 'species, stand_type')} SELECT species, stand_type, {r('rho')} FROM assoc "
        "QUALIFY row_number() OVER (ORDER BY species, stand_type) IN (9, 10, 19, 20)"
    )
    q["view_window"] = (
        f"WITH {SITE} SELECT plot, {rr('lon', 'lat')} FROM site WHERE lon BETWEEN -5.5 AND 10 AND lat BETWEEN 41 AND 52"
    )
    q["delimited_source"] = (
        f"WITH {PANEL} SELECT CAST(plot AS VARCHAR) AS plot, scenario, year, species, {r('value')} FROM cell WHERE scenario = 'N'"
    )
    q["stored_result"] = (
        f"WITH {PANEL},{IND} SELECT plot, species, {rr('growth_pct', 'share_shift')}, stand_type FROM ind"
    )
    q["series_for_species"] = f"""WITH {PANEL} SELECT plot, species, year, {r('value')} FROM cell
WHERE scenario = 'N' AND plot IN (1, 2, 3, 5, 8) AND species IN ('Brand#11', 'Brand#13', 'Brand#25')"""
    q["distribution_for_species"] = f"""WITH {PANEL},
one AS (SELECT year, value FROM cell WHERE scenario = 'N' AND species = 'Brand#13'),
{box("one", "value", "year")}
SELECT year, {BOX_COLUMNS} FROM box_stats"""
    q["dominant_species"] = f"""WITH {PANEL},
two AS (SELECT plot, species, value AS ini FROM cell WHERE scenario = 'N' AND year = 1995 AND value > 0),
top AS (SELECT plot, species, ini, SUM(ini) OVER (PARTITION BY plot) AS total,
               row_number() OVER (PARTITION BY plot ORDER BY ini DESC, species) AS place FROM two)
SELECT plot, species AS dominant, {r('ini / total', 'max_share')},
       CASE WHEN ini / total >= 0.15 THEN 'monospecifique' ELSE 'plurispecifique' END AS stand_type FROM top WHERE place = 1"""
    q["empty_column"] = f"WITH {PANEL},{IND} SELECT plot, species, {r('growth_pct')}, CAST(NULL AS DOUBLE) AS fertility FROM ind"
    q["category_cast"] = f"""WITH {PANEL},{IND},{GRADE}
SELECT CAST(grade AS VARCHAR) AS grade, COUNT(*) AS n, MIN(CAST(ind.plot AS VARCHAR)) AS first_plot
FROM ind LEFT JOIN grade g ON g.plot = ind.plot AND g.species = ind.species GROUP BY grade"""
    ends = "pos AS (SELECT grade, ln(growth_pct) AS ly FROM growths WHERE growth_pct > 0 AND grade <> 2)"
    q["ols_log_subset"] = (
        f"WITH {ANALYSED},{ends},{factor_model('pos', 'ly')} SELECT {COEF}, {r('r_squared')}, "
        "(SELECT COUNT(*) FROM growths WHERE growth_pct <= 0 AND grade <> 2) AS n_dropped FROM coef"
    )
    q["ols_pair_subset"] = q["ols_pair"].replace(MODELS, f"""{PANEL},{SITE},{indicator_ctes("A", name="im")},{indicator_ctes("R", name="ip")},
within AS (SELECT plot FROM site WHERE {inside_ring()}),
pairs AS (
  SELECT m.growth_pct AS value_m, p.growth_pct AS value_p FROM im m JOIN ip p ON m.plot = p.plot AND m.species = p.species
  WHERE m.plot IN (SELECT plot FROM within) AND m.species IN ('Brand#12', 'Brand#13', 'Brand#14'))""")
    # The normal distribution function by its series around zero, which needs no library.
    series = "list_sum(list_transform(range(0, 120), lambda k: coalesce(list_product(list_transform(range(1, k + 1), lambda j: z * z / (2 * j + 1))), 1.0) * z))"
    phi = f"CASE WHEN abs(z) > 8 THEN CASE WHEN z > 0 THEN 1.0 ELSE 0.0 END ELSE 0.5 + exp(-z * z / 2) / sqrt(2 * pi()) * {series} END"
    limit = "list_sum(list_transform(range(1, 60), lambda k: (CASE WHEN k % 2 = 1 THEN 2 ELSE -2 END) * exp(-2.0 * k * k * n * distance * distance)))"
    q["ks_normality"] = f"""WITH {PANEL},{IND},
x AS (SELECT share_shift AS v FROM ind WHERE share_shift IS NOT NULL),
m AS (SELECT COUNT(*) AS n, AVG(v) AS mean, stddev_samp(v) AS sd FROM x),
d AS (SELECT v, COUNT(*) AS c FROM x GROUP BY v),
e AS (SELECT v, c, SUM(c) OVER (ORDER BY v) AS upto FROM d),
p AS (SELECT upto, c, n, (v - mean) / sd AS z FROM e CROSS JOIN m),
f AS (SELECT *, {phi} AS phi FROM p),
g AS (SELECT MAX(n) AS n, MAX(greatest(upto / n - phi, phi - (upto - c) / n)) AS distance FROM f)
SELECT n, {r('distance')}, {r(f'least(1.0, {limit})', 'p_value')} FROM g"""
    q["site_source"] = f"WITH {SITE} SELECT CAST(plot AS VARCHAR) AS plot, greco, ser, {rr('alt', 'lon', 'lat')} FROM site"
    q["region_source"] = f"WITH {SITE} SELECT plot, {rr('lon', 'lat')} FROM site WHERE {inside_ring()}"
    q["regions_of_sites"] = f"WITH {SITE} " + " UNION ALL ".join(
        f"SELECT plot, '{name}' AS region FROM site WHERE {inside_ring(rings=rings)}" for name, rings in REGIONS.items()
    )
    q["inspected"] = f"WITH {PANEL},{IND} SELECT plot, species, {rr('ini', 'fin')} FROM ind ORDER BY plot, species LIMIT 6"
    q["scenario_results"] = f"""WITH {PANEL},{indicator_ctes("N", name="n")},{indicator_ctes("A", name="a")}
SELECT 'N' AS scenario, plot, species, {rr('ini', 'growth_pct')} FROM n WHERE ini >= 1
UNION ALL SELECT 'A', plot, species, {rr('ini', 'growth_pct')} FROM a WHERE ini >= 0"""
    q["delimited_rejects"] = f"""WITH {PANEL},
k AS (
  SELECT year, round(value, 2) AS value, CASE WHEN plot % 13 = 5 THEN 'number of fields' WHEN plot % 11 = 3 THEN 'year'
         WHEN plot % 7 = 0 THEN 'value' ELSE 'read' END AS outcome FROM cell WHERE scenario = 'N')
SELECT outcome, year, COUNT(*) AS n, {r('SUM(value)', 'total')} FROM k WHERE outcome = 'read' GROUP BY outcome, year
UNION ALL SELECT outcome, NULL, COUNT(*), NULL FROM k WHERE outcome <> 'read' GROUP BY outcome"""
    q["table_profile"] = f"WITH {PANEL},{IND} " + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", COUNT({c}) AS n, COUNT(*) - COUNT({c}) AS n_missing, {r(f'MIN({c})', 'min')},
       {r(f'quantile_cont({c}, 0.25)', 'q1')}, {r(f'quantile_cont({c}, 0.5)', 'median')}, {r(f'AVG({c})', 'mean')},
       {r(f'quantile_cont({c}, 0.75)', 'q3')}, {r(f'MAX({c})', 'max')} FROM ind"""
        for c in ("ini", "fin", "evol", "growth_pct", "share_shift", "max_share")
    )
    q["minimum_presence"] = f"WITH {PANEL},{IND} SELECT plot, species, {rr('ini', 'growth_pct')} FROM ind WHERE ini > 1"
    return q
