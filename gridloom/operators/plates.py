"""Plates, wells, fields of view and acquisitions as tables, the hierarchy of groups, and their metadata documents.

Tables: rows, columns (plate, name, idx); wells (plate, row_name, column_name); fovs (plate, row_name, column_name, ord, path,
acquisition_id); acquisitions (plate, id, name, description, start_time, end_time).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gridloom.plans.layout import RESERVED_FILES

WELL = ["plate", "row_name", "column_name"]
VERSION = "0.5"


def field_counts(fovs: DataFrame) -> DataFrame:
    """(plate, acquisition_id, most): the most images of one well, for each acquisition and, with a null id, for all together."""
    each = fovs.filter("acquisition_id is not null").groupBy(*WELL, "acquisition_id").count().groupBy("plate", "acquisition_id").agg(F.max("count").alias("most"))
    whole = fovs.groupBy(*WELL).count().groupBy("plate").agg(F.max("count").alias("most"))
    return each.unionByName(whole.withColumn("acquisition_id", F.lit(None).cast(each.schema["acquisition_id"].dataType)))


def well_index(wells: DataFrame, rows: DataFrame, columns: DataFrame) -> DataFrame:
    """Wells with the places of their row and column among the plate's names. ``unplaced_wells`` has those without a place."""
    r = rows.select("plate", F.col("name").alias("row_name"), F.col("idx").alias("row_index"))
    c = columns.select("plate", F.col("name").alias("column_name"), F.col("idx").alias("column_index"))
    return wells.join(r, ["plate", "row_name"]).join(c, ["plate", "column_name"]).select(*WELL, "row_index", "column_index")


def unplaced_wells(wells: DataFrame, rows: DataFrame, columns: DataFrame) -> DataFrame:
    """(plate, row_name, column_name, missing) of wells whose row or column the plate does not have."""
    r = rows.select("plate", F.col("name").alias("row_name"), F.lit(True).alias("_r"))
    c = columns.select("plate", F.col("name").alias("column_name"), F.lit(True).alias("_c"))
    both = wells.select(*WELL).join(r, ["plate", "row_name"], "left").join(c, ["plate", "column_name"], "left")
    missing = F.concat_ws(" and ", F.when(F.col("_r").isNull(), "row"), F.when(F.col("_c").isNull(), "column"))
    return both.filter("_r is null or _c is null").select(*WELL, missing.alias("missing"))


def missing_acquisitions(fovs: DataFrame, acquisitions: DataFrame) -> DataFrame:
    known = acquisitions.select("plate", F.col("id").alias("acquisition_id"))
    return fovs.filter("acquisition_id is not null").join(known, ["plate", "acquisition_id"], "left_anti")


def name_faults(names: DataFrame) -> DataFrame:
    """(plate, name, fault) of row or column names that are not letters and digits, or differ from another one at most by case."""
    low = names.select("plate", "name", F.lower("name").alias("low"))
    rows = low.join(low.groupBy("plate", "low").agg(F.count(F.lit(1)).alias("_n")), ["plate", "low"], "left")
    fault = F.when(~F.coalesce(F.col("name").rlike("^[A-Za-z0-9]+$"), F.lit(False)), "characters").when(F.col("_n") > 1, "repeated")
    return rows.select("plate", "name", fault.alias("fault")).filter("fault is not null").distinct()


def repeated_fields(fovs: DataFrame) -> DataFrame:
    """(plate, row_name, column_name, path, n) of image paths that a well has more than once."""
    return fovs.groupBy(*WELL, "path").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def array_keys(flat: DataFrame, fovs: DataFrame) -> DataFrame:
    """Distinct keys of flat arrays (``array_key``) and of the arrays of fields of view."""
    return flat.select("array_key").union(fovs.select(F.concat_ws("/", "plate", "row_name", "column_name", "path"))).distinct()


def prefixes(key: Column) -> Column:
    """All proper prefixes of a key, the shortest first; none for a key of one part."""
    parts = F.split(key, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).otherwise(F.array().cast("array<string>"))


def group_paths(keys: DataFrame) -> DataFrame:
    """All proper prefixes of the keys that are not arrays themselves."""
    out = keys.select(F.explode(prefixes(F.col("array_key"))).alias("path")).distinct()
    return out.join(keys.select(F.col("array_key").alias("path")), "path", "left_anti")


def tree_faults(arrays: DataFrame) -> DataFrame:
    """(array_key, fault) for ``arrays`` (array_key, multiscale).

    A key must occur once, hold no reserved file name behind its first part, not lie below a plain array, and not lie at a whole
    number below a multiscale array, where its levels are.
    """
    twice = arrays.groupBy("array_key").count().filter("count > 1").select("array_key", F.lit("repeated").alias("fault"))
    parts = F.split("array_key", "/")
    reserved = arrays.filter(F.exists(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: x.isin(*RESERVED_FILES))).select("array_key", F.lit("reserved name").alias("fault"))
    # the root array's key is empty and lies above all others
    up = F.filter(F.concat(F.array(F.lit("")), prefixes(F.col("array_key"))), lambda x: x != F.col("array_key"))
    below = arrays.select("array_key", F.explode(up).alias("above"))
    owners = arrays.select(F.col("array_key").alias("above"), F.col("multiscale").alias("_multi")).distinct()
    child = F.element_at(F.split(F.when(F.col("above") == "", F.col("array_key")).otherwise(F.expr("substr(array_key, length(above) + 2)")), "/"), 1)
    under = below.join(owners, "above").select("array_key", F.when(~F.col("_multi"), "below an array").when(child.rlike("^[0-9]+$"), "among levels").alias("fault")).filter("fault is not null")
    return twice.unionByName(reserved).unionByName(under).distinct()


def group_kinds(groups: DataFrame, wells: DataFrame) -> DataFrame:
    """(path, kind) of group paths: plate first, else well, else plain group."""
    plate = wells.select(F.col("plate").alias("path"), F.lit("plate").alias("_p")).distinct()
    well = wells.select(F.concat_ws("/", *WELL).alias("path"), F.lit("well").alias("_w")).distinct()
    return groups.select("path").join(plate, "path", "left").join(well, "path", "left").select("path", F.coalesce("_p", "_w", F.lit("group")).alias("kind"))


def _document(ome: Column) -> Column:
    return F.to_json(F.struct(F.lit(3).alias("zarr_format"), F.lit("group").alias("node_type"), F.struct(ome.alias("ome")).alias("attributes")))


def plate_documents(wells: DataFrame, rows: DataFrame, columns: DataFrame, fovs: DataFrame, acquisitions: DataFrame) -> DataFrame:
    """(path, document): the group document of each plate. An acquisition that no image names has a count of zero; null times are left out."""
    counts = field_counts(fovs)
    most = counts.filter("acquisition_id is null").select("plate", F.col("most").alias("field_count"))
    per = counts.filter("acquisition_id is not null").select("plate", F.col("acquisition_id").alias("id"), "most")
    acq = acquisitions.join(per, ["plate", "id"], "left")
    entry = F.struct(F.col("id").alias("id"), F.coalesce("most", F.lit(0)).alias("maximumfieldcount"), "name", "description", F.col("start_time").alias("starttime"), F.col("end_time").alias("endtime"))
    acq = acq.groupBy("plate").agg(F.sort_array(F.collect_list(entry)).alias("acquisitions"))
    names = lambda df, to: df.groupBy("plate").agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", "name"))), lambda x: F.struct(x["name"].alias("name"))).alias(to))
    index = well_index(wells, rows, columns)
    place = F.struct(F.col("row_index").alias("rowIndex"), F.col("column_index").alias("columnIndex"), F.concat_ws("/", "row_name", "column_name").alias("path"))
    listed = index.groupBy("plate").agg(F.sort_array(F.collect_list(place)).alias("wells"))
    whole = names(rows, "rows").join(names(columns, "columns"), "plate").join(listed, "plate", "left").join(acq, "plate", "left").join(most, "plate", "left")
    plate = F.struct(F.lit(VERSION).alias("version"), F.col("plate").alias("name"), F.coalesce("field_count", F.lit(0)).alias("field_count"), "rows", "columns", "wells", "acquisitions")
    return whole.select(F.col("plate").alias("path"), _document(F.struct(F.lit(VERSION).alias("version"), plate.alias("plate"))).alias("document"))


def well_documents(fovs: DataFrame) -> DataFrame:
    """(path, document): the group document of each well, with its images in their order."""
    images = F.transform(F.sort_array(F.collect_list(F.struct("ord", "path", "acquisition_id"))), lambda x: F.struct(x["path"].alias("path"), x["acquisition_id"].alias("acquisition")))
    whole = fovs.groupBy(*WELL).agg(images.alias("images"))
    return whole.select(F.concat_ws("/", *WELL).alias("path"), _document(F.struct(F.lit(VERSION).alias("version"), F.struct("images", F.lit(VERSION).alias("version")).alias("well"))).alias("document"))


def merged_metadata(writes: DataFrame, node: str, key: str, value: str, *order: str) -> DataFrame:
    """(node, key, value): of the writes of each metadata key the last in ``order``; the key ``ome`` is the store's own and is refused."""
    last = F.max_by(F.struct(value), F.struct(*order))
    return writes.filter(F.col(key) != "ome").groupBy(node, key).agg(last[value].alias(value))
