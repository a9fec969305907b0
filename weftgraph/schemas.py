"""Row types of class diagrams, activity graphs and the project catalog, and their normalised tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINT = "struct<x:double,y:double>"
SIZE = "struct<width:double,height:double>"
PARAMETER = "struct<name:string,datatype:string>"
ATTRIBUTE = "struct<name:string,datatype:string,visibility:string,default_value:string,static:boolean,final:boolean>"
METHOD = f"struct<name:string,visibility:string,parameters:array<{PARAMETER}>,return_type:string,static:boolean,abstract:boolean>"
CLASS = f"struct<id:string,name:string,kind:string,attributes:array<{ATTRIBUTE}>,methods:array<{METHOD}>,position:{POINT},size:{SIZE}>"
RELATIONSHIP = "struct<id:string,source:string,destination:string,type:string,multiplicity:struct<source:string,destination:string>,label:string>"
CLASS_DOC = f"struct<classes:array<{CLASS}>,relationships:array<{RELATIONSHIP}>>"
NODE = f"struct<id:string,type:string,label:string,position:{POINT},size:{SIZE}>"
EDGE = "struct<id:string,source:string,target:string,label:string>"
ACTIVITY_DOC = f"struct<nodes:array<{NODE}>,edges:array<{EDGE}>>"
CODE_INPUTS = "struct<class_code:string,class_language:string,activity_code:string,activity_language:string,function_name:string>"

PROJECTS = "id int, name string, project_type string, document string, activity_document string, code_inputs string, owner_id int, created_at timestamp_ntz, updated_at timestamp_ntz"
USERS = "id int, email string, username string, hashed_password string, created_at timestamp_ntz, password_changed_at timestamp_ntz"

#: The domains of the string enumerations.
VISIBILITIES = ("public", "private", "protected", "package")
CLASS_KINDS = ("class", "interface", "abstract")
RELATIONSHIP_TYPES = ("association", "aggregation", "composition", "inheritance", "realization", "dependency")
NODE_TYPES = ("start", "end", "action", "decision", "fork", "join")
PROJECT_TYPES = ("uml", "activity")
LANGUAGES = ("python", "java", "javascript")


def schema(ddl: str) -> T.DataType:
    return T._parse_datatype_string(ddl)


def parsed(json: Column, ddl: str) -> Column:
    """Strict JSON text to a typed value."""
    return F.from_json(json, schema(ddl), {"mode": "FAILFAST"})


def classes(docs: DataFrame, key: str = "doc_id", doc: str = "doc") -> DataFrame:
    """One row per class: key, ord and the class's fields with defaults."""
    rows = docs.select(key, F.posexplode(f"{doc}.classes").alias("ord", "c"))
    return rows.select(key, "ord", "c.id", "c.name", F.coalesce("c.kind", F.lit("class")).alias("kind"), "c.attributes", "c.methods", "c.position", "c.size")


def members(docs: DataFrame, what: str, key: str = "doc_id", doc: str = "doc") -> DataFrame:
    """``attributes`` or ``methods`` of all classes, with class_id, class_ord and ord."""
    rows = docs.select(key, F.posexplode(f"{doc}.classes").alias("class_ord", "c"))
    rows = rows.select(key, "class_ord", F.col("c.id").alias("class_id"), F.posexplode(f"c.{what}").alias("ord", "m")).select(key, "class_id", "class_ord", "ord", "m.*")
    no = {c: F.coalesce(c, F.lit(False)) for c in ("static", "final", "abstract") if c in rows.columns}
    return rows.withColumns(no | ({"return_type": F.coalesce("return_type", F.lit("void"))} if what == "methods" else {}))


def relationships(docs: DataFrame, key: str = "doc_id", doc: str = "doc") -> DataFrame:
    rows = docs.select(key, F.posexplode(f"{doc}.relationships").alias("ord", "r"))
    return rows.select(key, "ord", "r.id", "r.source", "r.destination", "r.type", F.col("r.multiplicity.source").alias("source_multiplicity"), F.col("r.multiplicity.destination").alias("multiplicity"), F.coalesce("r.label", F.lit("")).alias("label"))


def nodes(docs: DataFrame, key: str = "doc_id", doc: str = "doc") -> DataFrame:
    rows = docs.select(key, F.posexplode(f"{doc}.nodes").alias("ord", "n"))
    return rows.select(key, "ord", "n.id", "n.type", F.coalesce("n.label", F.lit("")).alias("label"), "n.position", "n.size")


def edges(docs: DataFrame, key: str = "doc_id", doc: str = "doc") -> DataFrame:
    rows = docs.select(key, F.posexplode(f"{doc}.edges").alias("ord", "e"))
    return rows.select(key, "ord", "e.id", "e.source", "e.target", F.coalesce("e.label", F.lit("")).alias("label"))
