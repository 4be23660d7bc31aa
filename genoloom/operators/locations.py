"""Features of several parts: their places, and their bases from tiled sequences.

``parts`` is an array of (start, stop, strand) in reading order: along the record on the plus strand, against it on the minus
strand, from the end over the origin into the start where a feature spans the origin of a circular record. Sequences are cut
into tiles, a feature's parts into the stretches that lie in one tile each, and both meet on (record, tile): no feature row
carries its record, and a record's features are spread over its tiles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genoloom.functions import codon as C
from genoloom.functions import sequence as S

#: Bases of a tile.
TILE = 1 << 14
PARTS = "array<struct<start:bigint,stop:bigint,strand:int>>"


def _part(start: Column, stop: Column, strand: Column) -> Column:
    return F.struct(start.cast("long").alias("start"), stop.cast("long").alias("stop"), strand.cast("int").alias("strand"))


def reading_order(parts: Column) -> Column:
    """Parts sorted along the record, turned if all are on the minus strand; mixed strands stay in record order."""
    along = F.array_sort(parts)
    return F.when(F.forall(parts, lambda p: p["strand"] < 0), F.reverse(along)).otherwise(along)


def with_parts(features: DataFrame) -> DataFrame:
    """features with ``parts`` (start, stop, strand): a feature without any is one part. Parts without a strand take the feature's and are put in reading order."""
    whole = F.array(_part(F.col("start"), F.col("stop"), F.col("strand")))
    if "parts" not in features.columns:
        return features.withColumn("parts", whole)
    if "strand" in features.schema["parts"].dataType.elementType.fieldNames():
        own = F.transform("parts", lambda p: _part(p["start"], p["stop"], p["strand"]))
    else:
        own = reading_order(F.transform("parts", lambda p: _part(p["start"], p["stop"], F.col("strand"))))
    return features.withColumn("parts", F.when(F.size("parts") > 0, own).otherwise(whole))


def over_origin(features: DataFrame, lengths: DataFrame, key: str = "record_id") -> DataFrame:
    """features of circular records with every part that runs over the record's end cut there and led on at the origin.

    lengths: (record, length). A part of start >= length lies wholly behind the origin. stop, start and other columns stay as
    they are; features of records without a length keep their parts.
    """
    n = F.col("_n")
    end = lambda p: F.when(p["stop"] > n, n).otherwise(p["stop"])
    cut = lambda p: F.when(p["start"] >= n, F.array(_part(p["start"] - n, p["stop"] - n, p["strand"]))).when(
        p["stop"] > n, F.when(p["strand"] < 0, F.array(_part(F.lit(0), p["stop"] - n, p["strand"]), _part(p["start"], end(p), p["strand"]))).otherwise(F.array(_part(p["start"], end(p), p["strand"]), _part(F.lit(0), p["stop"] - n, p["strand"])))
    ).otherwise(F.array(p))
    known = with_parts(features).join(lengths.select(key, F.col("length").cast("long").alias("_n")), key, "left")
    return known.withColumn("parts", F.when(n > 0, F.flatten(F.transform("parts", cut))).otherwise(F.col("parts"))).drop("_n")


def trim_phase(parts: Column, phase: Column) -> Column:
    """Parts without their first ``phase`` bases in reading order; null phase: none. A first part shorter than that becomes empty."""
    n = F.coalesce(phase.cast("long"), F.lit(0).cast("long"))
    first = lambda p: F.when(p["strand"] < 0, _part(p["start"], F.greatest(p["start"], p["stop"] - n), p["strand"])).otherwise(_part(F.least(p["start"] + n, p["stop"]), p["stop"], p["strand"]))
    return F.transform(parts, lambda p, i: F.when(i == 0, first(p)).otherwise(p))


def flanked(parts: Column, upstream: int, downstream: int) -> Column:
    """Parts with more bases before the first and after the last in reading order, by each one's strand, not before the record's start."""
    last = F.size(parts) - 1

    def grown(p: Column, i: Column) -> Column:
        before, after = F.when(i == 0, F.lit(upstream)).otherwise(0), F.when(i == last, F.lit(downstream)).otherwise(0)
        lo, hi = F.when(p["strand"] < 0, after).otherwise(before), F.when(p["strand"] < 0, before).otherwise(after)
        return _part(F.greatest(F.lit(0), p["start"] - lo), p["stop"] + hi, p["strand"])

    return F.transform(parts, grown)


def tile_sequences(seqs: DataFrame, key: str = "record_id", tile: int = TILE) -> DataFrame:
    """(record, _tile, _bases): sequences (seq_id, seq) cut into tiles of bytes; an empty sequence has one empty tile."""
    b = F.col("seq").cast("binary")
    last = F.greatest(F.floor((F.octet_length("seq") - 1) / tile), F.lit(0)).cast("int")
    rows = seqs.where("seq is not null").select(F.col("seq_id").alias(key), F.col("seq"), F.explode(F.sequence(F.lit(0), last)).alias("_tile"))
    return rows.select(key, "_tile", F.substring(b, F.col("_tile") * tile + 1, F.lit(tile)).alias("_bases"))


def _stretches(parts: Column, tile: int) -> Column:
    """(n, t, lo, size, minus) of each tile that a part lies in, in reading order; one empty stretch for a location without bases."""
    def of(p: Column, i: Column) -> Column:
        lo, minus = F.greatest(p["start"], F.lit(0)), p["strand"] < 0
        tiles = F.when(p["stop"] > lo, F.sequence(F.floor(lo / tile), F.floor((p["stop"] - 1) / tile)))
        one = lambda t: F.struct(i.alias("n"), t.cast("int").alias("t"), F.greatest(lo - t * tile, F.lit(0)).cast("int").alias("lo"), (F.least(p["stop"], (t + 1) * tile) - F.greatest(lo, t * tile)).cast("int").alias("size"), minus.alias("minus"))
        # a null array, of a part without bases, is filtered away below
        return F.transform(F.when(minus, F.reverse(tiles)).otherwise(tiles), one)

    every = F.flatten(F.filter(F.transform(parts, of), lambda x: x.isNotNull()))
    none = F.array(F.struct(F.lit(0).alias("n"), F.lit(0).alias("t"), F.lit(0).alias("lo"), F.lit(0).alias("size"), F.lit(False).alias("minus")))
    return F.when(F.size(every) > 0, every).otherwise(none)


def part_sequences(features: DataFrame, seqs: DataFrame, key: str = "record_id", tile: int = TILE, name: str = "seq") -> DataFrame:
    """features with the bases of their parts, one part after the other in reading order, each minus part turned.

    Features of records that seqs lacks go; what lies outside a record is left out. Most features lie in one tile and need no
    grouping; the others are put together once for each different location.
    """
    cut = with_parts(features).withColumn("_all", _stretches(F.col("parts"), tile))
    piece = lambda s: F.substring("_bases", s["lo"] + 1, s["size"]).cast("string")
    turned = lambda s: F.when(s["minus"], S.reverse_complement(piece(s))).otherwise(piece(s))
    tiles = tile_sequences(seqs, key, tile)
    single = cut.where(F.size("_all") == 1).withColumn("_s", F.get("_all", F.lit(0))).withColumn("_tile", F.col("_s.t"))
    single = single.join(tiles, [key, "_tile"], "left")
    # a location behind the record's end still belongs to a record that is there
    single = single.join(seqs.select(F.col("seq_id").alias(key)).distinct(), key, "left_semi").select(*features.columns, F.coalesce(turned(F.col("_s")), F.lit("")).alias(name))
    places = cut.where(F.size("_all") > 1)
    spread = places.select(key, "parts", "_all").distinct().select(key, "parts", F.posexplode("_all").alias("_i", "_s")).withColumn("_tile", F.col("_s.t"))
    met = spread.join(tiles, [key, "_tile"]).select(key, "parts", F.struct("_i", turned(F.col("_s")).alias("s")).alias("_x"))
    told = met.groupBy(key, "parts").agg(F.array_join(F.transform(F.array_sort(F.collect_list("_x")), lambda x: x["s"]), "").alias("_q"))  # one location's own bases
    told = told.withColumnRenamed("parts", "_parts")
    several = places.join(seqs.select(F.col("seq_id").alias(key)).distinct(), key, "left_semi").join(told.withColumnRenamed(key, "_k"), (F.col(key) == F.col("_k")) & (F.col("parts") == F.col("_parts")), "left")
    return single.unionByName(several.select(*features.columns, F.coalesce("_q", F.lit("")).alias(name)))


def _described(start: Column, stop: Column, strand: Column, phase: Column) -> Column:
    """[start:stop](strand) of a feature less its phase, the start counted from 1."""
    n = F.coalesce(phase.cast("long"), F.lit(0).cast("long"))
    minus = strand < 0
    sign = F.when(strand > 0, "+").when(minus, "-").otherwise("")
    lo, hi = start + 1 + F.when(minus, 0).otherwise(n), stop - F.when(minus, n).otherwise(0)
    return F.concat(F.lit("["), lo.cast("string"), F.lit(":"), hi.cast("string"), F.lit("]("), sign, F.lit(")"))


def extract_features(features: DataFrame, seqs: DataFrame, kind: str = "all", type: str = "CDS", key: str = "record_id", describe: bool = True, tile: int = TILE) -> DataFrame:  # noqa: A002
    """(record, feature_id, id, description, seq) of the features of a type.

    kind ``all`` and ``unique``: the phase is trimmed off the first part; ``nice``: it is not. Ids: the feature's own
    (all); record____id, and a second one of the same name takes ``__`` and a digest (unique); the locus tag or else the id,
    and in start order of a record the second and later ones of a name take _2, _3, ... (nice). Spaces become hyphens.
    Columns phase, name, product and locus_tag are used where features have them.
    """
    have = lambda c, t: F.col(c) if c in features.columns else F.lit(None).cast(t)
    own = with_parts(features.where(F.col("type") == type))
    phase, name, product, tag = have("phase", "int"), have("name", "string"), have("product", "string"), have("locus_tag", "string")
    plain = F.regexp_replace(F.coalesce(tag, F.col("feature_id")) if kind == "nice" else F.col("feature_id"), " ", "-")
    if kind == "nice":
        place = F.concat(F.lit("[Location="), _described(F.col("start") - 1, F.col("stop"), F.col("strand"), F.lit(0)), F.lit(";ID="), F.col("feature_id"), F.lit("]"))
        about = F.concat(F.coalesce(product, F.lit("")), F.lit(" "), place)
    else:
        about = F.concat(F.lit("[Location="), _described(F.col("start"), F.col("stop"), F.col("strand"), phase), F.when(name.isNotNull(), F.concat(F.lit(";Name="), name)).otherwise(""), F.lit("]"))
    rows = own.select(key, "feature_id", "start", "stop", "strand", "parts", phase.alias("_phase"), plain.alias("_id"), (about if describe else F.lit("")).alias("description"))
    if kind != "nice":
        rows = rows.withColumn("parts", trim_phase(F.col("parts"), F.col("_phase")))
    out = part_sequences(rows, seqs, key, tile)
    order = Window.partitionBy(key, "_id").orderBy("start", "stop", "feature_id", "parts")
    if kind == "nice":
        n = F.row_number().over(order)
        name_ = F.when(n > 1, F.concat(F.col("_id"), F.lit("_"), n.cast("string"))).otherwise(F.col("_id"))
    elif kind == "unique":
        n = F.row_number().over(order)
        full = F.concat(F.regexp_replace(F.col(key).cast("string"), " ", "-"), F.lit("____"), F.col("_id"))
        name_ = F.when(n > 1, F.concat(full, F.lit("__"), F.md5(F.concat_ws(":", full, n.cast("string"))))).otherwise(full)
    else:
        name_ = F.col("_id")
    return out.select(key, "feature_id", name_.alias("id"), "description", "seq")


def export_features(features: DataFrame, seqs: DataFrame, types: list[str], upstream: int = 0, downstream: int = 0, translate: bool = False, strip_stops: bool = False, number: int = 11, informative: bool = False, key: str = "record_id", tile: int = TILE) -> DataFrame:
    """(record, feature_id, definition, seq) of features of the given types, with more bases before and after, or as proteins.

    Upstream bases go before the first part and downstream bases after the last, within the record; with upstream bases, the
    codon start (column codon_start, 1 if there is none) still counts from the first base taken. A protein is the translation
    of the joined parts; a stop at the end goes with ``strip_stops``. The definition lists the parts, from 1, ``informative``
    with the product before them.
    """
    have = lambda c, t: F.col(c) if c in features.columns else F.lit(None).cast(t)
    own = with_parts(features.where(F.col("type").isin(types)))
    grown = flanked(F.col("parts"), upstream, downstream)
    shift = F.coalesce(have("codon_start", "int"), F.lit(1)) - 1
    listed = F.array_join(F.transform(grown, lambda p: F.concat(F.lit("[start="), (p["start"] + 1).cast("string"), F.lit(",end="), p["stop"].cast("string"), F.lit("]"))), ", joined with ")
    definition = F.concat(F.coalesce(have("product", "string"), F.lit("")), F.lit(" "), listed) if informative else listed
    rows = own.select(key, "feature_id", definition.alias("definition"), trim_phase(grown, shift).alias("parts"), "start", "stop", "strand")
    out = part_sequences(rows, seqs, key, tile)
    seq = S.translate(F.col("seq"), number, to_stop=False) if translate else F.col("seq")
    if strip_stops:
        seq = F.regexp_replace(seq, r"\*$", "") if translate else F.when(F.upper(F.right(seq, F.lit(3))).isin(*C.stops(number)), F.substring(seq, F.lit(1), F.length(seq) - 3)).otherwise(seq)
    return out.select(key, "feature_id", "definition", seq.alias("seq"))


def location_text(parts: Column) -> Column:
    """The flat-file text of parts in reading order: bounds from 1, complement(...) and join(...)."""
    place = lambda p: F.concat((p["start"] + 1).cast("string"), F.lit(".."), p["stop"].cast("string"))
    joined = lambda xs: F.when(F.size(xs) > 1, F.concat(F.lit("join("), F.array_join(xs, ","), F.lit(")"))).otherwise(F.array_join(xs, ","))
    minus = F.forall(parts, lambda p: p["strand"] < 0)
    each = F.transform(parts, lambda p: F.when(p["strand"] < 0, F.concat(F.lit("complement("), place(p), F.lit(")"))).otherwise(place(p)))
    return F.when(minus, F.concat(F.lit("complement("), joined(F.transform(F.reverse(parts), place)), F.lit(")"))).otherwise(joined(each))


def parse_location(text: Column) -> Column:
    """Parts in reading order of a flat-file location: join, order and complement, single bases and sites; parts on other records go.

    complement around a list turns its order and its strands.
    """
    own = F.regexp_replace(text, r"(complement\()?[A-Za-z][\w.]*:[<>]?\d+(?:(?:\.\.|\^|\.)[<>]?\d+)?", "")
    number = lambda x: x.try_cast("long")
    bounds = r"(complement\()?[<>]?(\d+)(?:(?:\.\.|\^|\.)[<>]?(\d+))?"
    group = lambda k: F.regexp_extract_all(own, F.lit(bounds), F.lit(k))
    turned = own.rlike(r"^\s*complement\(\s*(join|order)")
    raw = F.zip_with(F.zip_with(group(2), group(3), lambda a, b: F.struct((number(a) - 1).alias("a"), F.coalesce(number(b), number(a)).alias("b"))), group(1), lambda p, c: _part(p["a"], p["b"], F.when((c != "") != turned, -1).otherwise(1)))
    return F.when(turned, F.reverse(raw)).otherwise(raw)
