"""Element constants joined to atoms, and the factors derived from them.

Factors depend on an atom only through its *species*: the element label together
with the volume scale kappa. They are computed once per species and length of q.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scatterloom.functions import constants
from scatterloom.operators.params import fan_out, localize


def _patterns(elements: DataFrame) -> DataFrame:
    """``label, __re, __prefix``: patterns for whole names, and the letters that every match begins with.

    These are the plain letters in front, without the last one if a quantifier follows it; none where a pattern has alternatives.
    """
    regex = F.col("name_regex")
    plain = F.regexp_extract(regex, "^[A-Za-z0-9 ]*", 0)
    after = F.substring(regex, F.length(plain) + 1, F.lit(1))
    sure = F.when(after.isin("?", "*", "+", "{"), F.substring(plain, F.lit(1), F.length(plain) - 1)).otherwise(plain)
    prefix = F.when(F.contains(regex, F.lit("|")), F.lit("")).otherwise(sure)
    return elements.select("label", F.concat(F.lit("^(?:"), regex, F.lit(")$")).alias("__re"), prefix.alias("__prefix"))


def _matches(names: DataFrame, elements: DataFrame) -> DataFrame:
    """``__name, label``: the patterns that match each of the distinct ``__name``.

    A pattern meets only the names that begin with its letters, by an equality join; patterns without such letters meet all names.
    """
    patterns = _patterns(elements)
    starts = F.transform(F.sequence(F.lit(1), F.length("__name")), lambda n: F.substring(F.col("__name"), F.lit(1), n))
    begun = names.where("__name <> ''").select("__name", F.explode(starts).alias("__prefix"))
    keyed = begun.join(patterns.where("__prefix <> ''"), "__prefix").where("__name rlike __re")
    free = names.join(patterns.where("__prefix = ''"), F.expr("__name rlike __re"))
    return keyed.select("__name", "label").unionAll(free.select("__name", "label"))


def _match_table(names: DataFrame, elements: DataFrame) -> DataFrame:
    """``__name, __n, __label``: how many patterns match each name, and the first label of these."""
    found = _matches(names, elements).groupBy("__name").agg(F.count("label").alias("__n"), F.min("label").alias("__label"))
    return names.join(found, "__name", "left").withColumn("__n", F.coalesce("__n", F.lit(0)))


def resolve_labels(atoms: DataFrame, elements: DataFrame, name: str = "pdb_name") -> DataFrame:
    """Add ``label``: the one element whose pattern matches the whole atom name.

    Patterns are tried on distinct names only, and at once: a name with no match or with
    several is an error. The names found are few and joined back without moving the atoms.
    """
    found = _match_table(atoms.select(F.col(name).alias("__name")).distinct(), elements)
    problem = F.concat(
        F.lit("atom name matches "), F.col("__n").cast("string"), F.lit(" elements: "), "__name"
    )
    label = F.when(F.col("__n") == 1, F.col("__label")).otherwise(F.raise_error(problem))
    one = localize(found.select("__name", label.alias("label")))
    return atoms.drop("label").join(one, atoms[name] == one["__name"]).drop("__name")


def match_counts(names: DataFrame, elements: DataFrame, name: str) -> DataFrame:
    """Number of matching elements for each distinct name: anything but 1 is a fault."""
    found = _match_table(names.select(F.col(name).alias("__name")).distinct(), elements)
    return found.select(F.col("__name").alias(name), F.col("__n").alias("n_elements"))


def with_constants(atoms: DataFrame, elements: DataFrame) -> DataFrame:
    """Atoms with the constants of their element."""
    return atoms.join(elements.drop("name_regex"), "label")


def kappa_table(atoms: DataFrame, kappas: DataFrame, selections: DataFrame) -> DataFrame:
    """Volume scale of every atom: of the entries that cover it the last wins, else 1."""
    scaled = (
        selections.join(kappas, "selection")
        .groupBy("atom_id")
        .agg(F.max_by("value", "ord").alias("kappa"))
    )
    return atoms.select("atom_id").join(scaled, "atom_id", "left").na.fill(1.0, ["kappa"])


def species_id(label="label", kappa=None) -> Column:
    """Name of a species; the plain label where no volume scale is in use."""
    label = F.col(label) if isinstance(label, str) else label
    if kappa is None:
        return label
    kappa = F.col(kappa) if isinstance(kappa, str) else kappa
    return F.when(kappa == 1.0, label).otherwise(F.concat_ws("*", label, kappa.cast("string")))


def species_table(atoms: DataFrame, elements: DataFrame) -> DataFrame:
    """Distinct species of ``atoms(label[, kappa])`` with their constants."""
    kappa = F.col("kappa") if "kappa" in atoms.columns else F.lit(1.0)
    kinds = atoms.select("label", kappa.alias("kappa")).distinct()
    return with_constants(kinds, elements).withColumn("species", species_id("label", "kappa"))


def raw_factor(q: Column) -> Column:
    return constants.scattering_factor(F.col("sf_type"), F.col("sf_params"), q)


def exclusion_of(q: Column) -> Column:
    v = F.col("kappa") * constants.volume(F.col("vol_type"), F.col("vol_params"))
    return constants.exclusion(F.col("excl_type"), F.col("excl_params"), v, q)


def effective_factors(species: DataFrame, qvectors: DataFrame, background: float | Column = 0.0) -> DataFrame:
    """``(q_id, species, f)`` with f = scattering factor - background * exclusion factor.

    One evaluation per vector and species; ``background`` may be a column such as a
    scalar subquery of :func:`background_density`.
    """
    rho = F.lit(background) if not isinstance(background, Column) else background
    kinds = species.select(
        "species", "kappa", "vol_type", "vol_params", "excl_type", "excl_params", "sf_type", "sf_params"
    )
    q = F.col("ql")
    return fan_out(qvectors.select("q_id", "ql"), kinds, ["species"]).select(
        "q_id", "species", (raw_factor(q) - rho * exclusion_of(q)).alias("f")
    )


def background_density(atoms: DataFrame, elements: DataFrame) -> DataFrame:
    """One row ``density``: sum of factors over sum of exclusion factors at q = 0."""
    kappa = F.col("kappa") if "kappa" in atoms.columns else F.lit(1.0)
    counted = atoms.groupBy("label", kappa.alias("kappa")).agg(F.count("*").alias("n"))
    zero = F.lit(0.0)
    sums = with_constants(counted, elements)
    return sums.agg(
        (F.sum(F.col("n") * raw_factor(zero)) / F.sum(F.col("n") * exclusion_of(zero))).alias("density")
    )


# Number of scattering parameters each type code needs.
SF_PARAMS = {0: 1, 1: 15, 2: 9}


def validate_elements(elements: DataFrame) -> DataFrame:
    """``(label, problem)`` for every missing constant; empty when all is well."""
    checks = [(F.col("mass").isNull(), "mass missing")]
    for what, prefix in (("volume", "vol"), ("exclusion", "excl"), ("scattering", "sf")):
        kind, params = F.col(f"{prefix}_type"), F.col(f"{prefix}_params")
        checks.append((kind.isNull(), f"{what} type missing"))
        checks.append(
            (kind.isNotNull() & (params.isNull() | (F.size(params) == 0)), f"{what} constants missing")
        )
        checks.append((kind.isNotNull() & ~kind.isin(0, 1, 2), f"{what} type not known"))
    needed = F.when(F.col("sf_type") == 0, SF_PARAMS[0])
    needed = needed.when(F.col("sf_type") == 1, SF_PARAMS[1]).when(F.col("sf_type") == 2, SF_PARAMS[2])
    present = F.size("sf_params")
    checks.append(((present > 0) & (present < needed), "scattering constants incomplete"))
    problems = F.filter(
        F.array(*(F.when(bad, F.lit(text)) for bad, text in checks)), lambda p: p.isNotNull()
    )
    return elements.where(F.col("name_regex").isNotNull()).select(
        "label", F.explode(problems).alias("problem")
    )
