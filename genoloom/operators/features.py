"""Operators on feature tables: one flat row a feature, (record_id, type, start, stop, strand, feature_id, parent, attrs).

``parent`` is the id of the feature above, null at the top; ``attrs`` maps a qualifier to its values. Trees are walked by
one join a level. Predicates are Spark columns.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genoloom.functions import sequence as S
from genoloom.operators.blocked import running
from genoloom.operators.locations import part_sequences
from genoloom.operators.ordered import ordered_positions
from genoloom.session import materialize

UP = "_up"


def descendants(features: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, feature_id): all features below each root id, however deep; a root in a cycle is not below itself.

    One join on the parent for each level, until a level brings nothing new; levels are written, so lineage stays short.
    """
    edges = features.where(F.col("parent").isNotNull()).select("parent", F.col("feature_id").alias("_child"))
    level = seen = roots.select(F.col("feature_id").alias("root"), "feature_id").distinct()
    found = []
    while True:
        below = level.join(edges, F.col("feature_id") == F.col("parent")).select("root", F.col("_child").alias("feature_id")).distinct()
        level = materialize(below.join(seen, ["root", "feature_id"], "left_anti"), "tree-level")
        found.append(level)
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return reduce(DataFrame.unionByName, found)


def tree_depths(features: DataFrame) -> DataFrame:
    """(feature_id, _depth) of the features below others: 1 for a child of a top feature, and so on; those in cycles are left out."""
    edges = features.where(F.col("parent").isNotNull()).select("parent", F.col("feature_id").alias("_child"))
    level, found = features.where(F.col("parent").isNull()).select("feature_id").distinct(), []
    while True:
        level = materialize(level.join(edges, F.col("feature_id") == F.col("parent")).select(F.col("_child").alias("feature_id")).distinct(), "tree-level")
        found.append(level.withColumn("_depth", F.lit(len(found) + 1)))
        if level.isEmpty():
            break
    return reduce(DataFrame.unionByName, found).groupBy("feature_id").agg(F.max("_depth").alias("_depth"))


def filter_tree(features: DataFrame, predicate: Column, invert: bool = False, below: bool = True) -> DataFrame:
    """Features that pass the predicate (or do not); with ``below``, all their descendants too. A null outcome does not pass."""
    ok = F.coalesce(predicate, F.lit(False))
    hit = features.where(~ok if invert else ok)
    if not below:
        return hit
    # Only whether a feature is below any hit matters here, so all hits share one root and no feature is walked twice.
    tops = hit.select("feature_id")
    edges = features.where(F.col("parent").isNotNull()).select("parent", F.col("feature_id").alias("_child"))
    level = seen = tops.distinct()
    while True:
        kids = level.join(edges, F.col("feature_id") == F.col("parent")).select(F.col("_child").alias("feature_id")).distinct()
        level = materialize(kids.join(seen, "feature_id", "left_anti"), "tree-level")
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return features.join(seen, "feature_id", "left_semi")


def orphan_parents(features: DataFrame) -> DataFrame:
    """Features with the parent set to null where no row has that id."""
    ids = features.select(F.col("feature_id").alias(UP)).distinct()
    return features.join(ids, F.col("parent") == F.col(UP), "left").withColumn("parent", F.col(UP)).drop(UP)


def filter_type(features: DataFrame, types: list[str]) -> DataFrame:
    """Features of the listed types, letter case aside; parents that are gone are cleared."""
    return orphan_parents(features.where(F.upper("type").isin([t.upper() for t in types])))


def drop_types(features: DataFrame, types: list[str]) -> DataFrame:
    """Features of other types."""
    return features.where(~F.col("type").isin(types))


def filter_qualifier_value(features: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Features with a listed value under any of the keys."""
    found = F.flatten(F.array(*(F.coalesce(F.try_element_at("attrs", F.lit(k)), F.array().cast("array<string>")) for k in keys)))
    return features.where(F.arrays_overlap(found, F.array(*map(F.lit, values))))


def filter_qualifier_contains(features: DataFrame, keys: list[str], parts: list[str]) -> DataFrame:
    """Features that have every key, with a value that contains one of the parts under each."""
    has = lambda k: F.exists(F.try_element_at("attrs", F.lit(k)), lambda v: F.exists(F.array(*map(F.lit, parts)), lambda p: F.contains(v, p)))
    out = features
    for k in keys:
        out = out.where(F.coalesce(has(k), F.lit(False)))
    return out


def filter_by_tag(features: DataFrame, feature_type: str, tag: str, text: str) -> DataFrame:
    """Features of a type that have a value of a tag that contains a text."""
    return filter_qualifier_contains(features.where(F.col("type") == feature_type), [tag], [text])


def filter_at_location(features: DataFrame, loc: int, strand: int | None = None) -> DataFrame:
    """Features with start <= loc <= stop."""
    out = features.where(F.lit(loc).between(F.col("start"), F.col("stop")))
    return out if strand is None else out.where(F.col("strand") == strand)


def filter_contains(features: DataFrame, lo: int, hi: int | None = None) -> DataFrame:
    """Features that hold an index, or both ends of a range, strictly inside."""
    return features.where((F.col("start") < lo) & (F.col("stop") > (lo if hi is None else hi)))


def coding_genes(features: DataFrame) -> DataFrame:
    """Genes with at least one CDS below."""
    genes = features.where(F.col("type") == "gene")
    coding = descendants(features, genes).join(features.where(F.col("type") == "CDS").select("feature_id"), "feature_id", "left_semi")
    return genes.join(coding.select(F.col("root").alias("feature_id")), "feature_id", "left_semi")


def filter_records(rows: DataFrame, wanted: DataFrame, key: str = "record_id", strict: bool = True) -> DataFrame:
    """Rows whose record is listed (strict) or contains a listed text; wanted: (accession)."""
    if strict:
        return rows.join(wanted.withColumnRenamed("accession", key), key, "left_semi")
    return rows.join(wanted, F.contains(F.col(key).cast("string"), F.col("accession").cast("string")), "left_semi")


def search_terms(rows: DataFrame, terms: list[str], text: str, id_col: str) -> DataFrame:
    """(id, term): rows whose text contains a term, letter case aside; the term list is a literal, so rows are read once and never joined."""
    found = F.filter(F.array(*map(F.lit, sorted(set(terms)))), lambda t: F.contains(F.lower(text), F.lower(t)))
    return rows.select(id_col, F.explode(found).alias("term")).distinct()


def _places(features: DataFrame, key: str) -> DataFrame:
    """features with _n: the place in start order of the record, counted in range blocks, so that a hot record is no single task."""
    record = F.struct(F.col(key).alias("r"))  # a struct groups features of no record too
    order = [F.col("start"), F.col("stop"), F.col("feature_id")]
    return ordered_positions(features.withColumn("_record", record), ["_record"], order, "_n").drop("_record")


def nearby_k(features: DataFrame, centres: DataFrame, k: int, key: str = "record_id") -> DataFrame:
    """(centre, feature): features at most k places from a centre in start order of its record."""
    return adjacent_k(features, centres, k, key).select("centre", "feature")


def adjacent_k(features: DataFrame, centres: DataFrame, k: int, key: str = "record_id") -> DataFrame:
    """(centre, feature, side): the k features before and after a centre; up and down swap on the minus strand."""
    ranked = _places(features.select(key, "feature_id", "start", "stop", "strand"), key).select(key, "feature_id", "strand", "_n")
    steps = F.explode(F.array(*(F.lit(i) for i in range(-k, k + 1) if i))).alias("_d")
    middle = ranked.join(centres.select("feature_id").distinct(), "feature_id", "left_semi").select(key, F.col("feature_id").alias("centre"), F.col("strand").alias("_s"), "_n", steps)
    met = ranked.join(middle.withColumn("_n", F.col("_n") + F.col("_d")), [key, "_n"])
    side = F.when((F.col("_d") < 0) == (F.col("_s") > 0), "up").otherwise("down")
    return met.select("centre", F.col("feature_id").alias("feature"), side.alias("side"))


def adjacent_to_protein(features: DataFrame, seqs: DataFrame, proteins: DataFrame, behind: int = 1, forward: int = 1, type: str = "CDS", number: int = 11, key: str = "record_id") -> DataFrame:  # noqa: A002
    """(query, centre, feature, side, apart): neighbours of every feature of a type whose translation equals a query protein.

    proteins: (query, protein); stops at the end are not compared. ``behind`` features before and ``forward`` features after a
    centre along the record count, among those of its type; on the minus strand those after it are its ``up`` side. apart is
    the distance in places. Proteins meet by their text, so a query that many records hold is spread by them.
    """
    own = features.where(F.col("type") == type)
    text = lambda c: F.regexp_replace(c, r"\*+$", "")
    coded = part_sequences(own, seqs, key, name="_dna").select("feature_id", text(S.translate(F.col("_dna"), number, to_stop=False)).alias("_p"))
    centres = coded.join(proteins.select("query", text(F.upper("protein")).alias("_p")).where("_p <> ''"), "_p").select("query", F.col("feature_id").alias("centre"))
    centres = materialize(centres, "adjacent-centres")
    k = max(behind, forward)
    ranked = _places(own.select(key, "feature_id", "start", "stop", "strand"), key).select(key, "feature_id", "strand", "_n")
    steps = F.explode(F.array(*(F.lit(i) for i in range(-behind, forward + 1) if i))).alias("_d") if k else F.explode(F.array().cast("array<int>")).alias("_d")
    middle = ranked.join(centres.select(F.col("centre").alias("feature_id")).distinct(), "feature_id", "left_semi").select(key, F.col("feature_id").alias("centre"), F.col("strand").alias("_s"), "_n", steps)
    met = ranked.join(middle.withColumn("_n", F.col("_n") + F.col("_d")), [key, "_n"])
    side = F.when((F.col("_d") < 0) == (F.col("_s") > 0), "up").otherwise("down")
    return centres.join(met.select("centre", F.col("feature_id").alias("feature"), side.alias("side"), F.abs("_d").alias("apart")), "centre").select("query", "centre", "feature", "side", "apart")


def upstream_feature(features: DataFrame, key: str = "record_id") -> DataFrame:
    """(feature_id, upstream, distance): the nearest feature before each one on its strand, in its record."""
    slim = features.select(key, "feature_id", "start", "stop", (F.col("strand") > 0).alias("_plus"))
    own = F.struct("feature_id", "start", "stop")
    before = running(slim.where("_plus"), [key], ["stop", "start", "feature_id"], {"_u": ("last", own, "before")})
    after = running(slim.where("not _plus or _plus is null"), [key], ["start", "stop", "feature_id"], {"_u": ("last", own, "after")})
    gap = F.when(F.col("_plus"), F.col("start") - F.col("_u.stop")).otherwise(F.col("_u.start") - F.col("stop"))
    return before.unionByName(after).select("feature_id", F.col("_u.feature_id").alias("upstream"), gap.alias("distance"))


def moron_rule(genes: DataFrame, key: str = "record_id") -> DataFrame:
    """Genes whose two neighbours on either side are all on the other strand; genes without two on each side fail."""
    placed = _places(genes, key)
    near = placed.select(F.col(key).alias("_r"), F.col("strand").alias("_s"), F.explode(F.array(*(F.col("_n") + d for d in (-2, -1, 1, 2)))).alias("_m"))
    four = near.groupBy("_r", "_m").agg(F.collect_list("_s").alias("_others"))  # at most four
    met = placed.join(four, F.col(key).eqNullSafe(F.col("_r")) & (F.col("_n") == F.col("_m")))
    return met.where((F.size("_others") == 4) & ~F.array_contains("_others", F.col("strand"))).select(genes.columns)


def sort_by_start(features: DataFrame, key: str = "record_id") -> DataFrame:
    """Features in start order of each record, with their place."""
    return _places(features, key).withColumn("place", F.col("_n") + 1).drop("_n")


# --- rewriting


def retype(features: DataFrame, types: list[str], to: str) -> DataFrame:
    """A set of types becomes one."""
    return features.withColumn("type", F.when(F.col("type").isin(types), to).otherwise(F.col("type")))


def retype_short_exons(features: DataFrame, below: int = 20) -> DataFrame:
    """Exons shorter than ``below`` are Shine-Dalgarno sequences."""
    short = (F.col("type") == "exon") & (F.col("stop") - F.col("start") < below)
    return features.withColumn("type", F.when(short, "Shine_Dalgarno_sequence").otherwise(F.col("type")))


def extract_qualifier(features: DataFrame, key: str) -> DataFrame:
    """(feature_id, value): the first value of a qualifier; null without one."""
    return features.select("feature_id", F.try_element_at(F.try_element_at("attrs", F.lit(key)), F.lit(1)).alias("value"))


def remove_qualifiers(features: DataFrame, feature_type: str, tag: str, text: str) -> DataFrame:
    """Values of a tag that contain a text are taken out of features of a type; a tag without values goes."""
    kept = F.map_filter(F.transform_values("attrs", lambda k, v: F.when(k == tag, F.filter(v, lambda x: ~F.contains(x, F.lit(text)))).otherwise(v)), lambda k, v: F.size(v) > 0)
    return features.withColumn("attrs", F.when(F.col("type") == feature_type, kept).otherwise(F.col("attrs")))


def promote_qualifier(features: DataFrame, key: str, parent_type: str, child_type: str) -> DataFrame:
    """Parents take a qualifier from their first child (5' end by strand) that has it."""
    kids = features.where((F.col("type") == child_type) & F.map_contains_key("attrs", key)).select(F.col("parent").alias("_p"), F.col("attrs")[key].alias("_v"), F.when(F.col("strand") > 0, F.col("start")).otherwise(-F.col("stop")).alias("_o"), F.col("feature_id").alias("_c"))
    first = kids.groupBy("_p").agg(F.min_by("_v", F.struct("_o", "_c")).alias("_v"))
    out = features.join(first, (F.col("feature_id") == F.col("_p")) & (F.col("type") == parent_type), "left")
    added = F.map_concat(F.map_filter("attrs", lambda k, v: k != key), F.create_map(F.lit(key), F.col("_v")))
    return out.withColumn("attrs", F.when(F.col("_v").isNotNull(), added).otherwise(F.col("attrs"))).drop("_p", "_v")


def product_to_grandparent(features: DataFrame) -> DataFrame:
    """Genes take the product of a CDS that is two levels (or one) below; the smallest feature id wins."""
    cds = features.where((F.col("type") == "CDS") & F.map_contains_key("attrs", "product")).select("parent", "feature_id", F.col("attrs")["product"].alias("_v"))
    up = features.select(F.col("feature_id").alias("_m"), F.col("parent").alias("_g"))
    tops = cds.join(up, F.col("parent") == F.col("_m")).select(F.coalesce("_g", "_m").alias("_t"), "feature_id", "_v").groupBy("_t").agg(F.min_by("_v", "feature_id").alias("_v"))
    out = features.join(tops, (F.col("feature_id") == F.col("_t")) & (F.col("type") == "gene"), "left")
    added = F.map_concat(F.map_filter("attrs", lambda k, v: k != "product"), F.create_map(F.lit("product"), F.col("_v")))
    return out.withColumn("attrs", F.when(F.col("_v").isNotNull(), added).otherwise(F.col("attrs"))).drop("_t", "_v")


def copy_cds_qualifiers(features: DataFrame) -> DataFrame:
    """Genes take the qualifiers of their only CDS, but for ID, Parent and Name."""
    cds = features.where(F.col("type") == "CDS").groupBy(F.col("parent").alias("_p")).agg(F.count("*").alias("_n"), F.first("attrs").alias("_a")).where("_n = 1")
    out = features.join(cds, (F.col("feature_id") == F.col("_p")) & (F.col("type") == "gene"), "left")
    own = F.map_filter("_a", lambda k, v: ~k.isin("ID", "Parent", "Name"))
    rest = F.map_filter("attrs", lambda k, v: ~F.coalesce(F.map_contains_key(own, k), F.lit(False)))
    return out.withColumn("attrs", F.when(F.col("_p").isNotNull(), F.map_concat(rest, own)).otherwise(F.col("attrs"))).drop("_p", "_n", "_a")


def add_parent_chain(features: DataFrame, child_types: list[str], chain: list[str]) -> DataFrame:
    """Features of the listed types gain new ancestors of the chain's types, outermost first, with ids made from their own."""
    marked = features.withColumn("_wrap", F.col("type").isin(child_types))
    ids = [F.concat(F.col("feature_id"), F.lit(f".{t}")) for t in chain]
    levels = F.array(*(F.struct(F.lit(t).alias("type"), ids[i].alias("feature_id"), (ids[i - 1] if i else F.col("parent")).alias("parent")) for i, t in enumerate(chain)))
    new = marked.where("_wrap").withColumn("_x", F.explode(levels)).withColumns({c: F.col(f"_x.{c}") for c in ("type", "feature_id", "parent")})
    own = marked.withColumn("parent", F.when(F.col("_wrap"), ids[-1]).otherwise(F.col("parent")))
    return own.unionByName(new.drop("_x")).drop("_wrap")


def add_parent_genes(features: DataFrame) -> DataFrame:
    """Each CDS gains gene > mRNA parents."""
    return add_parent_chain(features, ["CDS"], ["gene", "mRNA"])


def drop_middle_level(features: DataFrame, middle: str = "mRNA") -> DataFrame:
    """A level goes; its children hang on its parent."""
    level = features.where(F.col("type") == middle).select(F.col("feature_id").alias("_m"), F.col("parent").alias("_p"))
    out = features.where(F.col("type") != middle).join(level, F.col("parent") == F.col("_m"), "left")
    return out.withColumn("parent", F.when(F.col("_m").isNotNull(), F.col("_p")).otherwise(F.col("parent"))).drop("_m", "_p")


def add_exons(features: DataFrame, move_cds: bool = False) -> DataFrame:
    """One exon over the direct CDS children of each gene; ``move_cds`` hangs them on it."""
    cds = features.where((F.col("type") == "CDS") & F.col("parent").isNotNull())
    exon = cds.groupBy("record_id", "parent").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.first("strand").alias("strand"))
    exon = exon.select("record_id", F.lit("exon").alias("type"), "start", "stop", "strand", F.concat("parent", F.lit(".exon")).alias("feature_id"), "parent")
    if move_cds:
        inside = (F.col("type") == "CDS") & F.col("parent").isNotNull()
        features = features.withColumn("parent", F.when(inside, F.concat("parent", F.lit(".exon"))).otherwise(F.col("parent")))
    return features.unionByName(exon, allowMissingColumns=True)


def genes_from_pairs(features: DataFrame, name: str) -> DataFrame:
    """Two features of one name in a record, a CDS and an RBS, get a gene over both."""
    pair = features.where(F.col("type").isin("CDS", "RBS")).groupBy("record_id", name).agg(F.count("*").alias("n"), F.count_distinct("type").alias("k"), F.min("start").alias("start"), F.max("stop").alias("stop"))
    return pair.where("n = 2 and k = 2").select("record_id", F.col(name).alias("name"), "start", "stop")


def fminmax(features: DataFrame) -> DataFrame:
    """(feature_id, start, stop): the extent of each top feature and all below it."""
    top = features.where(F.col("parent").isNull())
    below = descendants(features, top).join(features.select("feature_id", "start", "stop"), "feature_id").select(F.col("root").alias("feature_id"), "start", "stop")
    return top.select("feature_id", "start", "stop").unionByName(below).groupBy("feature_id").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))


def display_name(attrs: Column, feature_id: Column) -> Column:
    """The first of locus_tag, gene, Gene, product, Product, Name that has a value, else the id."""
    first = lambda k: F.try_element_at(F.try_element_at(attrs, F.lit(k)), F.lit(1))
    return F.coalesce(*map(first, ("locus_tag", "gene", "Gene", "product", "Product", "Name")), feature_id)


def escape_text(text: Column) -> Column:
    """Characters other than letters, digits and ._:- become underscores."""
    return F.regexp_replace(text, r"[^A-Za-z0-9._:-]", "_")


def merge_annotations(features: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """The listed qualifiers of features gain the values that a second set (feature_id, attrs) has for the same id; values are distinct and sorted."""
    flat = other.select("feature_id", F.explode("attrs").alias("k", "vs")).where(F.col("k").isin(keys)).select("feature_id", "k", F.explode("vs").alias("v"))
    per_key = flat.groupBy("feature_id", "k").agg(F.collect_set("v").alias("vs")).groupBy("feature_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "vs"))).alias("_more"))
    empty = F.array().cast("array<string>")
    both = F.map_zip_with("attrs", "_more", lambda k, a, b: F.when(b.isNull(), a).otherwise(F.array_sort(F.array_union(F.coalesce(a, empty), b))))
    return features.join(per_key, "feature_id", "left").withColumn("attrs", F.when(F.col("_more").isNull(), F.col("attrs")).otherwise(both)).drop("_more")


def update_from_table(features: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(features, log): an edit table (feature_id, new_start, new_stop, new_strand) applied by id; the log has one status a line of the table."""
    out = features.join(edits, "feature_id", "left")
    for c in ("start", "stop", "strand"):
        out = out.withColumn(c, F.coalesce(f"new_{c}", c))
    known = edits.join(features.select("feature_id", "start", "stop", "strand"), "feature_id", "left")
    changed = F.array_compact(F.array(*(F.when(F.col(f"new_{c}").isNotNull() & (F.col(f"new_{c}") != F.col(c)), c) for c in ("start", "stop", "strand"))))
    status = F.when(F.col("start").isNull(), "ID not Found").when(F.size(changed) == 0, "No Change").otherwise("Success")
    log = known.select("feature_id", status.alias("status"), F.array_join(changed, ",").alias("changed"))
    return out.select(features.columns), log


#: What the log calls each change, in its order.
EDIT_NAMES = {"name": "Name", "alias": "Alias", "parent": "Parent", "start": "Start", "stop": "End", "strand": "Strand", "note": "Notes", "other": "Other Qualifiers"}


def edit_from_table(features: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(features, log): a table of edits applied by id, with its log (feature_id, changed, status).

    edits: (feature_id, unique) and any of name, alias, parent (the first value of the qualifier of that name), new_start,
    new_stop, new_strand (bounds as in features), note, and further columns, which become qualifiers of the column's name in
    lower case with underscores. A column that is there but null leaves bounds, names and parent as they are, makes an
    empty note, and takes another qualifier away. features: (feature_id, parent, start, stop, strand, attrs). The log names what
    changed in the order of EDIT_NAMES, or None: ``Success``, ``No Change`` or ``ID not Found``.
    """
    own = [c for c in edits.columns if c != "feature_id"]
    bounds = [c for c in ("start", "stop", "strand") if f"new_{c}" in own]
    heads = [c for c in ("name", "alias", "parent") if c in own]
    others = [c for c in own if c not in ("name", "alias", "parent", "note") and c not in {f"new_{b}" for b in bounds}]
    e = edits.select("feature_id", *(F.col(c).alias(f"_e_{c}") for c in own), F.lit(True).alias("_there"))
    rows = features.join(e, "feature_id", "left")
    first = lambda k: F.try_element_at(F.try_element_at("attrs", F.lit(k)), F.lit(1))
    old = lambda c: F.col("parent") if c == "parent" else first(c.capitalize())
    changed = {c: F.col(f"_e_{c}").isNotNull() & ~F.col(f"_e_{c}").eqNullSafe(old(c)) for c in heads}
    changed |= {b: F.col(f"_e_new_{b}").isNotNull() & (F.col(f"_e_new_{b}") != F.col(b)) for b in bounds}
    values: dict[str, Column] = {c.capitalize(): F.when(changed[c], F.array(F.col(f"_e_{c}"))).otherwise(F.try_element_at("attrs", F.lit(c.capitalize()))) for c in heads}
    if "note" in own:
        now, note = F.try_element_at("attrs", F.lit("Note")), F.coalesce("_e_note", F.lit(""))
        changed["note"] = F.col("_there") & F.when(now.isNotNull(), now != F.array(note)).otherwise(note != "")
        values["Note"] = F.when(changed["note"], F.array(note)).otherwise(now)
    keys = {c: re.sub(" ", "_", c.lower()) for c in others}
    each = {c: F.col("_there") & ~F.when(F.col(f"_e_{c}").isNotNull(), F.array(F.col(f"_e_{c}").cast("string"))).eqNullSafe(F.try_element_at("attrs", F.lit(k))) for c, k in keys.items()}
    if others:
        changed["other"] = reduce(or_, each.values())
        values |= {keys[c]: F.when(x, F.when(F.col(f"_e_{c}").isNotNull(), F.array(F.col(f"_e_{c}").cast("string")))).otherwise(F.try_element_at("attrs", F.lit(keys[c]))) for c, x in each.items()}
    entries = F.array(*(F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in values.items())) if values else F.array()
    kept = F.map_filter("attrs", lambda k, v: ~k.isin(*values)) if values else F.col("attrs")
    attrs = F.map_concat(kept, F.map_from_entries(F.filter(entries, lambda x: x["value"].isNotNull()))) if values else kept
    names = F.array_compact(F.array(*(F.when(F.coalesce(changed[c], F.lit(False)), F.lit(EDIT_NAMES[c])) for c in EDIT_NAMES if c in changed)))
    new = {b: F.coalesce(f"_e_new_{b}", b) for b in bounds} | ({"parent": F.coalesce("_e_parent", "parent")} if "parent" in own else {})
    new["attrs"] = F.when(F.col("_there"), attrs).otherwise(F.col("attrs"))
    rows = rows.withColumn("_changed", names)
    log = edits.select("feature_id").join(rows.where("_there").select("feature_id", "_changed"), "feature_id", "left")
    status = F.when(F.col("_changed").isNull(), "ID not Found").when(F.size("_changed") == 0, "No Change").otherwise("Success")
    log = log.select("feature_id", F.when(F.size("_changed") > 0, F.array_join("_changed", ", ")).otherwise("None").alias("changed"), status.alias("status"))
    return rows.withColumns(new).select(features.columns), log


def rename_from_table(features: DataFrame, names: DataFrame) -> DataFrame:
    """(feature_id, name): the new name by parent id, then by own id; ``Not Found`` without one. names: (id, name)."""
    by_parent = names.select(F.col("id").alias("parent"), F.col("name").alias("_a"))
    by_id = names.select(F.col("id").alias("feature_id"), F.col("name").alias("_b"))
    return features.join(by_parent, "parent", "left").join(by_id, "feature_id", "left").select("feature_id", F.coalesce("_a", "_b", F.lit("Not Found")).alias("name"))


def renumber(genes: DataFrame, members: DataFrame, prefix: str, digits: int, key: str = "record_id") -> DataFrame:
    """(feature_id, tag): members take ``prefix_NNN`` of their gene, numbered in start order of the record; members: (feature_id, parent)."""
    number = (F.col("_n") + 1).cast("string")
    padded = F.when(F.length(number) < digits, F.lpad(number, digits, "0")).otherwise(number)  # lpad alone cuts longer numbers
    tags = _places(genes.select(key, "feature_id", "start", "stop"), key).select("feature_id", F.concat(F.lit(f"{prefix}_"), padded).alias("tag"))
    return tags.unionByName(members.select(F.col("feature_id").alias("_f"), "parent").join(tags, F.col("parent") == F.col("feature_id")).select(F.col("_f").alias("feature_id"), "tag"))


def locus_tags(genes: DataFrame, cds: DataFrame, key: str = "record_id") -> DataFrame:
    """(feature_id, gene, note): each CDS with the gene that shares its strand and 3' end; the smallest id of several; ``no gene`` without one."""
    end = F.when(F.col("strand") > 0, F.col("stop")).otherwise(F.col("start"))
    own = genes.groupBy(key, "strand", end.alias("_e")).agg(F.min("feature_id").alias("gene"))
    out = cds.withColumn("_e", end).join(own, [key, "strand", "_e"], "left")
    return out.select("feature_id", "gene", F.when(F.col("gene").isNull(), "no gene").otherwise("same 3' end").alias("note"))


def feature_color_class(features: DataFrame, rules: list[tuple[str, str]], text: str = "product", custom: list[tuple[str, list[str], list[str]]] = ()) -> DataFrame:
    """(feature_id, class): the last of the ordered (class, pattern) rules that the text meets, letter case aside.

    A custom rule (class, words, other words) overrides them where the text has all its words and none of the others; the last one wins.
    """
    out = F.lit(None).cast("string")
    for name, pattern in rules:
        out = F.when(F.lower(text).rlike(pattern), name).otherwise(out)
    has = lambda w: F.coalesce(F.col(text).rlike(rf"\b{w}\b"), F.lit(False))
    for name, words, others in custom:
        out = F.when(reduce(and_, [*map(has, words), *(~has(w) for w in others)]), name).otherwise(out)
    return features.select("feature_id", out.alias("class"))


def parent_child_types(features: DataFrame) -> DataFrame:
    """(parent_type, type, n) in use."""
    up = features.select(F.col("feature_id").alias("_p"), F.col("type").alias("parent_type"))
    return features.join(up, F.col("parent") == F.col("_p")).groupBy("parent_type", "type").agg(F.count("*").alias("n"))


def merge_feature_sets(records: DataFrame, features: DataFrame, more: DataFrame, key: str = "record_id") -> DataFrame:
    """Features of a second set join those of the first, for the records listed."""
    return features.unionByName(more.join(records.select(key).distinct(), key, "left_semi"), allowMissingColumns=True)


def feature_tag_counts(features: DataFrame, locus: str = "parent") -> DataFrame:
    """Per locus: features of each kind, and a message where the rules (one CDS, at most one RBS) fail."""
    is_rbs = F.col("type").isin("RBS", "Shine_Dalgarno_sequence")
    out = features.where(F.col(locus).isNotNull()).groupBy(locus).agg(F.count_if(F.col("type") == "CDS").alias("cds"), F.count_if(is_rbs).alias("rbs"), F.count("*").alias("all"))
    message = F.when(F.col("cds") == 0, "no CDS").when(F.col("cds") > 1, "several CDS").when(F.col("rbs") > 1, "several RBS")
    return out.withColumn("message", message)


# --- joins


def id_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side): ids in both tables, only left, or only right."""
    a, b = left.select(key).distinct().withColumn("_l", F.lit(1)), right.select(key).distinct().withColumn("_r", F.lit(1))
    side = F.when(F.col("_l").isNull(), "right").when(F.col("_r").isNull(), "left").otherwise("both")
    return a.join(b, key, "full").select(key, side.alias("side"))


def text_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, invert: bool = False) -> DataFrame | tuple[DataFrame, DataFrame]:
    """Inner many-to-many join on a column of each; inverted, the rows of either side without a partner."""
    on = F.col(left_key) == F.col(right_key)
    return (left.join(right, on, "left_anti"), right.join(left, on, "left_anti")) if invert else left.join(right, on)


def zip_append(left: DataFrame, right: DataFrame, order: str = "ord") -> DataFrame:
    """Records of two tables paired by place: ids joined by an underscore, sequences one after the other."""
    b = right.select(order, F.col("seq_id").alias("_id"), F.col("seq").alias("_seq"))
    return left.join(b, order).select(F.concat_ws("_", F.col("seq_id").cast("string"), F.col("_id").cast("string")).alias("seq_id"), F.concat("seq", "_seq").alias("seq"))


def rebase(parents: DataFrame, children: DataFrame, protein: bool = False) -> DataFrame:
    """Children given relative to a parent feature (record_id = its id) in the parent's coordinates: times three for proteins, mirrored on the minus strand."""
    k = 3 if protein else 1
    p = parents.select(F.col("feature_id").alias("_p"), F.col("record_id").alias("_r"), F.col("start").alias("_s"), F.col("stop").alias("_e"), F.col("strand").alias("_d"))
    out = children.join(p, F.col("record_id") == F.col("_p"))
    plus = F.col("_d") > 0
    start = F.when(plus, F.col("_s") + k * F.col("start")).otherwise(F.col("_e") - k * F.col("stop"))
    stop = F.when(plus, F.col("_s") + k * F.col("stop")).otherwise(F.col("_e") - k * F.col("start"))
    strand = F.when(plus, F.col("strand")).otherwise(-F.col("strand"))
    return out.select("feature_id", F.col("_r").alias("record_id"), start.alias("start"), stop.alias("stop"), strand.alias("strand"))


def _five(strand: Column, start: Column, stop: Column) -> Column:
    return F.when(strand > 0, start).otherwise(stop)


def gene_diff(a: DataFrame, b: DataFrame, key: str = "record_id") -> DataFrame:
    """(record, end5, status, id_differs, strand_differs): genes of two sets matched by 5' end; the smallest id of several stands for an end."""

    def side(d: DataFrame, x: str) -> DataFrame:
        return d.groupBy(key, _five(F.col("strand"), F.col("start"), F.col("stop")).alias("end5")).agg(F.min(F.struct("feature_id", "strand")).alias(x))

    j = side(a, "x").join(side(b, "y"), [key, "end5"], "full")
    status = F.when(F.col("y").isNull(), "only first").when(F.col("x").isNull(), "only second").otherwise("both")
    return j.select(key, "end5", status.alias("status"), (F.col("x.feature_id") != F.col("y.feature_id")).alias("id_differs"), (F.col("x.strand") != F.col("y.strand")).alias("strand_differs"))


def gene_differences(a: DataFrame, b: DataFrame, key: str = "record_id") -> DataFrame:
    """(record, end5, first, second, differs): genes of two sets matched by 5' end, whatever their strand, with what differs: id, qualifiers, strand, start.

    Of several genes of a set with one 5' end the last by start and id counts; an unmatched gene has null on the other side and
    for differs. Where strands differ, starts are not compared; where they agree, the 5' ends do too, so ``start`` can't differ
    then, and is listed for other ways of matching. a and b: (record, feature_id, start, stop, strand, attrs).
    """

    def side(d: DataFrame, x: str) -> DataFrame:
        entries = F.array_sort(F.map_entries("attrs"))
        row = F.struct("start", "feature_id", "stop", "strand", F.transform(entries, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"))).alias("attrs"))
        return d.groupBy(key, _five(F.col("strand"), F.col("start"), F.col("stop")).alias("end5")).agg(F.max(row).alias(x))

    j = side(a, "x").join(side(b, "y"), [key, "end5"], "full")
    same = F.col("x.strand") == F.col("y.strand")
    flags = [("id", F.col("x.feature_id") != F.col("y.feature_id")), ("qualifiers", ~F.col("x.attrs").eqNullSafe(F.col("y.attrs"))), ("strand", ~same), ("start", same & (_five(F.col("x.strand"), F.col("x.start"), F.col("x.stop")) != _five(F.col("y.strand"), F.col("y.start"), F.col("y.stop"))))]
    differs = F.array_join(F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in flags))), ",")
    return j.select(key, "end5", F.col("x.feature_id").alias("first"), F.col("y.feature_id").alias("second"), F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), differs).alias("differs"))


def feature_match(a: DataFrame, b: DataFrame, key: str = "record_id") -> DataFrame:
    """(status, n): features of two sets matched by 3' end and strand: same place, moved start, only first, only second."""
    end = F.when(F.col("strand") > 0, F.col("stop")).otherwise(F.col("start"))

    def side(d: DataFrame, x: str) -> DataFrame:
        return d.groupBy(key, "strand", end.alias("end3")).agg(F.min(F.struct("start", "stop")).alias(x))

    j = side(a, "x").join(side(b, "y"), [key, "strand", "end3"], "full")
    status = F.when(F.col("y").isNull(), "only first").when(F.col("x").isNull(), "only second").when(F.col("x") == F.col("y"), "same").otherwise("moved start")
    return j.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def answer_score(answers: DataFrame, key_features: DataFrame, who: str, key: str = "record_id") -> DataFrame:
    """Per submitter: 1 for each feature with a key's start and stop, 0.5 for the same start alone, against the best of all."""
    k = key_features.select(key, "start", F.col("stop").alias("_stop")).distinct()
    point = F.max(F.when(F.col("_stop") == F.col("stop"), 1.0).when(F.col("_stop").isNotNull(), 0.5).otherwise(0.0))
    each = answers.join(k, [key, "start"], "left").groupBy(who, "feature_id").agg(point.alias("p"))
    total = each.groupBy(who).agg(F.sum("p").alias("score"))
    best = total.agg(F.max("score").alias("best"))
    return total.join(F.broadcast(best)).select(who, "score", F.try_divide("score", "best").alias("share"))  # best is one row


def codon_usage_compare(a: DataFrame, b: DataFrame, number: int = 11) -> DataFrame:
    """(codon, residue, first, second): shares of all 64 codons in two counts (codon, n)."""
    from genoloom.functions import codon as C

    every = a.sparkSession.createDataFrame(sorted(C.table(number).items()), "codon string, residue string")
    share = lambda d, name: d.select("codon", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias(name))  # noqa: E731  at most 64 rows
    out = every.join(share(a, "first"), "codon", "left").join(share(b, "second"), "codon", "left")
    return out.select("codon", "residue", F.coalesce("first", F.lit(0.0)).alias("first"), F.coalesce("second", F.lit(0.0)).alias("second"))


def seq_feature_extract(features: DataFrame, seqs: DataFrame, key: str = "record_id") -> DataFrame:
    """(feature_id, seq): the bases of each feature, its parts joined in reading order, minus parts turned; what lies beyond the sequence is cut."""
    return part_sequences(features, seqs, key).select("feature_id", "seq")
