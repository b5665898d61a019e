"""Connector listings as external documents.

Listings come from stored API replies (one JSON document per row) or from an
object store listing. Credentials belong to the cluster's file system settings
and never travel in the data.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clerkwise.functions.text import basename, mime_guess
from clerkwise.operators.imports import reject_reason

COLUMNS = ("connector_type", "external_id", "filename", "content_type", "download_url", "size_bytes", "metadata")


def _text(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit(""))


def _positive(col: Column) -> Column:
    """Size as a number; 0 and anything unreadable mean unknown."""
    return F.nullif(col.try_cast("long"), F.lit(0).cast("long"))


def _documents(rows: DataFrame, connector: str, **columns: Column) -> DataFrame:
    meta = columns.pop("metadata")
    pairs = [part for key, value in meta.items() for part in (F.lit(key), value)]
    return rows.select(
        *[c for c in rows.columns if c in ("payload_id", "position")],
        F.lit(connector).alias("connector_type"),
        *[columns[c].alias(c) for c in COLUMNS[1:-1]], F.create_map(*pairs).alias("metadata"))


def _rows_of(df: DataFrame, schema: str, path: Callable[[Column], Column], name: str) -> DataFrame:
    """One row per element of an array inside the parsed payload, in order."""
    parsed = F.from_json("payload", schema)
    return df.select(*[c for c in df.columns if c != "payload"], F.posexplode(path(parsed)).alias("position", name))


def escaped(col: Column, keep_slash: bool = True) -> Column:
    """Percent-escaped for a URL path: a blank is %20, a slash stays if asked for."""
    quoted = F.replace(F.replace(F.replace(F.url_encode(col), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    return F.replace(quoted, F.lit("%2F"), F.lit("/")) if keep_slash else quoted


def object_url(kind: str, bucket: str, endpoint: str, key: Column) -> Column:
    """Where the bytes of an object are: S3 by path, GCS by its media address with the whole key as one segment."""
    if kind == "gcs":
        return F.concat(F.lit(f"{endpoint}/storage/v1/b/{bucket}/o/"), escaped(key, False), F.lit("?alt=media"))
    return F.concat(F.lit(f"{endpoint}/"), escaped(key))


def object_store(objects: DataFrame, kind: str, bucket: str, endpoint: str,
                 prefix: str = "") -> DataFrame:
    """S3 or GCS objects (key, size[, content_type]); folder markers are left out."""
    key = F.col("key")
    wanted = objects.filter(F.startswith(key, F.lit(prefix.strip())) & ~F.endswith(key, F.lit("/"))
                            & (_text(key) != ""))
    name = basename(key)
    given = F.col("content_type") if "content_type" in objects.columns and kind == "gcs" else mime_guess(name)
    size = _positive(F.col("size")) if kind == "gcs" else F.col("size").cast("long")
    meta_key = "object_name" if kind == "gcs" else "key"
    return _documents(
        wanted, kind, external_id=F.concat(F.lit(f"{kind}_{bucket}_"), key), filename=name, content_type=given,
        download_url=object_url(kind, bucket, endpoint.rstrip("/"), key), size_bytes=size,
        metadata={"bucket": F.lit(bucket), meta_key: key})


def servicenow(df: DataFrame, base_url: str) -> DataFrame:
    """Records, then the attachments of each record."""
    records = _rows_of(
        df, """result array<struct<sys_id:string,number:string,short_description:string,
               attachments:array<struct<sys_id:string,file_name:string,content_type:string,size_bytes:string>>>>""",
        lambda p: p["result"], "record").filter(_text(F.col("record.sys_id")) != "")
    rows = records.select(*[c for c in records.columns if c not in ("position",)],
                          F.posexplode("record.attachments").alias("position", "att"))
    att, sys_id = F.col("att"), _text(F.col("att.sys_id"))
    return _documents(
        rows, "servicenow", external_id=F.concat(F.lit("sn_"), sys_id),
        filename=F.coalesce(att["file_name"], F.concat(F.lit("attachment_"), F.substring(sys_id, 1, 8))),
        content_type=att["content_type"],
        download_url=F.concat(F.lit(f"{base_url}/api/now/attachment/"), sys_id, F.lit("/file")),
        size_bytes=_positive(att["size_bytes"]),
        metadata={"record_number": _text(F.col("record.number")),
                  "record_description": _text(F.col("record.short_description"))})


def confluence(df: DataFrame, base_url: str) -> DataFrame:
    """Pages, then the attachments among their children."""
    pages = _rows_of(
        df, """results array<struct<id:string,title:string,children:struct<attachment:struct<results:array<struct<
               id:string,title:string,mediaType:string,extensions:struct<fileSize:long>,`_links`:struct<download:string>>>>>>>""",
        lambda p: p["results"], "page")
    rows = pages.select(*[c for c in pages.columns if c != "position"],
                        F.posexplode("page.children.attachment.results").alias("position", "att"))
    att = F.col("att")
    link = F.nullif(_text(att["_links"]["download"]), F.lit(""))
    return _documents(
        rows, "confluence", external_id=F.concat(F.lit("conf_"), _text(att["id"])),
        filename=F.coalesce(att["title"], F.lit("attachment")), content_type=att["mediaType"],
        download_url=F.concat(F.lit(base_url), link), size_bytes=att["extensions"]["fileSize"],
        metadata={"page_id": _text(F.col("page.id")), "page_title": _text(F.col("page.title"))})


def jira(df: DataFrame) -> DataFrame:
    """Issues, then their attachment field."""
    issues = _rows_of(
        df, """issues array<struct<key:string,fields:struct<summary:string,attachment:array<struct<
               id:string,filename:string,mimeType:string,content:string,size:long,created:string,
               author:struct<displayName:string>>>>>>""",
        lambda p: p["issues"], "issue")
    rows = issues.select(*[c for c in issues.columns if c != "position"],
                         F.posexplode("issue.fields.attachment").alias("position", "att"))
    att = F.col("att")
    return _documents(
        rows, "jira", external_id=F.concat(F.lit("jira_"), _text(att["id"])),
        filename=F.coalesce(att["filename"], F.lit("attachment")), content_type=att["mimeType"],
        download_url=att["content"], size_bytes=att["size"],
        metadata={"issue_key": _text(F.col("issue.key")), "issue_summary": _text(F.col("issue.fields.summary")),
                  "author": _text(att["author"]["displayName"]), "created": _text(att["created"])})


def salesforce(df: DataFrame, instance_url: str, version: str = "v59.0") -> DataFrame:
    """Attachment records. ``created_date`` in the metadata gives newest-first."""
    rows = _rows_of(
        df, "records array<struct<Id:string,Name:string,ContentType:string,BodyLength:long,ParentId:string,CreatedDate:string>>",
        lambda p: p["records"], "rec")
    rec = F.col("rec")
    return _documents(
        rows, "salesforce", external_id=F.concat(F.lit("sf_"), _text(rec["Id"])),
        filename=F.coalesce(rec["Name"], F.lit("attachment")), content_type=rec["ContentType"],
        download_url=F.concat(F.lit(f"{instance_url}/services/data/{version}/sobjects/Attachment/"), rec["Id"], F.lit("/Body")),
        size_bytes=rec["BodyLength"],
        metadata={"parent_id": _text(rec["ParentId"]), "created_date": _text(rec["CreatedDate"])})


def newest_first(listing: DataFrame, limit: int) -> DataFrame:
    return listing.orderBy(F.element_at("metadata", F.lit("created_date")).desc(), "external_id").limit(limit)


def sharepoint(df: DataFrame, site_url: str, library: str = "Documents") -> DataFrame:
    """Library items that have both a name and a reference."""
    rows = _rows_of(
        df, "d struct<results:array<struct<Id:string,FileLeafRef:string,FileRef:string,File:struct<Length:string>>>>",
        lambda p: p["d"]["results"], "item")
    item = F.col("item")
    name, ref = _text(item["FileLeafRef"]), _text(item["FileRef"])
    rows = rows.filter((name != "") & (ref != ""))
    return _documents(
        rows, "sharepoint", external_id=F.concat(F.lit("sp_"), _text(item["Id"]), F.lit("_"), name),
        filename=name, content_type=mime_guess(name),
        download_url=F.concat(F.lit(f"{site_url}/_api/web/getfilebyserverrelativeurl('"), escaped(F.replace(ref, F.lit("'"), F.lit("''"))), F.lit("')/$value")),
        size_bytes=item["File"]["Length"].try_cast("long"),
        metadata={"library": F.lit(library), "file_ref": ref, "item_id": _text(item["Id"])})


# Listing functions over stored replies by connector type; add to extend.
CONNECTORS: dict[str, Callable[..., DataFrame]] = {
    "confluence": confluence,
    "jira": jira,
    "salesforce": salesforce,
    "servicenow": servicenow,
    "sharepoint": sharepoint,
}


def list_external(connector_type: str, df: DataFrame, **options) -> DataFrame:
    if connector_type not in CONNECTORS:
        raise ValueError(f"Unknown connector type: {connector_type}")
    return CONNECTORS[connector_type](df, **options)


def acceptable(listing: DataFrame) -> DataFrame:
    """Listing rows with the reason they would be refused, judged by metadata."""
    kind = F.coalesce(F.nullif("content_type", F.lit("")), mime_guess(F.col("filename")), F.lit("application/octet-stream"))
    return listing.withColumn("reject_reason", reject_reason(F.col("filename"), kind, F.coalesce("size_bytes", F.lit(1))))
