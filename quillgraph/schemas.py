"""Row schemas of the document graph. Spark never infers them."""

SECTIONS = "doc_id string, seq int, heading string, heading_level int, content string, page_number int"
CHUNKS = "chunk_id string, doc_id string, seq int, content string, heading_path array<string>, pages array<int>, tokens int, kind string, section_title string, first_in_section boolean, last_in_section boolean, overlap string"
EXTRACTIONS = "chunk_id string, entities array<struct<name:string,type:string,aliases:array<string>,properties:map<string,string>,confidence:double>>, relationships array<struct<source:string,relationship:string,target:string,properties:map<string,string>,confidence:double,evidence:string>>, confidence double"
EXTRACTED = EXTRACTIONS + ", model string, input_tokens long, output_tokens long"
SENTINEL = "embedding_model string, paragraph_dims int, entity_dims int, applied_at long"
PROCESSING_LOG = "file_path string, content_hash string, processed_at long, status string, error_message string, document_id string, cost_usd double, seq long"
CALLS = "call_type string, model string, document_id string, chunk_id string, input_tokens long, output_tokens long, cost_usd double, at long"
MERGES = "merged_id string, canonical_id string, similarity double, decision string, applied boolean"
