"""Types of the array columns that operators pass on."""

from __future__ import annotations

PARAGRAPH = "struct<idx:int,text:string,element_type:string,is_atomic:boolean,language:string,source_idx:int,section:string>"
PARAGRAPHS = f"array<{PARAGRAPH}>"
SECTION = "struct<section_ord:int,title:string,level:int,parent_ord:int>"
SECTIONS = f"array<{SECTION}>"
PROPOSAL = "struct<position:int,similarity:double,text_before:string,text_after:string>"
PROPOSALS = f"array<{PROPOSAL}>"
DECISION = "struct<position:int,similarity:double,verdict:string,reason:string,adjusted_position:int,confidence:double>"
DECISIONS = f"array<{DECISION}>"
METADATA = "struct<chunk_id:string,title:string,summary:string,intent:string,questions:array<string>,keywords:array<string>,parent_section:string,token_count:int>"
CHUNK = f"struct<chunk_ord:int,content:string,source_paragraphs:array<int>,parent_section:string,metadata:{METADATA}>"
CHUNKS = f"array<{CHUNK}>"
REPLY = "struct<content:string,tokens_used:int,success:boolean,error:string>"
REPLIES = f"array<{REPLY}>"
#: What a parser returns for a document.
PARSED = f"struct<paragraphs:{PARAGRAPHS},sections:{SECTIONS}>"
