"""Explicit schemas; nothing is inferred from data, and every field may be null."""

from __future__ import annotations

FINDING = (
    "struct<id:string,category:string,summary:string,file:string,anchor:string,line:int,severity:string,suggested_action:string,"
    "related_assertions:array<string>,resolves:array<string>,status:string,closed_reason:string,closed_at:string,closed_by:string,promoted_to:string>"
)

ENTRY = (
    "struct<slug:string,feature:string,result:string,completed_at:string,surface:string,kind:string,scope_summary:string,phases:int,rejection_cycles:int,"
    "previous_failures:array<struct<id:string,summary:string>>,contract:struct<total:int,satisfied:int,unsatisfied:int,deviated:int>,"
    "assertions:array<struct<id:string,says:string,status:string,deviation:string>>,"
    "acceptance_criteria:struct<total:int,met:int,partial:int,coverage:struct<pinned:int,judgment:int,retired:int,uncovered:int,weak_only:int>>,"
    "timing:struct<total_minutes:int,think:int,plan:int,build:int,verify:int,segments:array<struct<stage:string,minutes:int,phase:int>>>,"
    f"modules_touched:array<string>,hashes:map<string,string>,findings:array<{FINDING}>>"
)

TRANSCRIPT = (
    "struct<type:string,requestId:string,timestamp:string,message:struct<model:string,"
    "usage:struct<input_tokens:int,output_tokens:int,cache_creation_input_tokens:int,cache_read_input_tokens:int>,"
    "content:array<struct<type:string,name:string,text:string,input:struct<file_path:string,command:string>>>>>"
)
