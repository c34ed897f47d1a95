"""Schemas of element tables."""

INFO = "struct<version:bigint,timestamp:bigint,changeset:bigint,user_id:bigint,user:string,visible:boolean>"
TAGS = "array<struct<key:string,val:string>>"
MEMBERS = "array<struct<type:int,ref:bigint,role:string>>"

#: One row per element of any kind (0 node, 1 way, 2 relation).
ELEMENT = f"type int, id bigint, changetype int, quadtree bigint, info {INFO}, tags {TAGS}, lon bigint, lat bigint, refs array<bigint>, members {MEMBERS}"
COLUMNS = ["type", "id", "changetype", "quadtree", "info", "tags", "lon", "lat", "refs", "members"]
