"""Schemas of the records that are read and written."""

GOLDEN = "id string, query string, user_id long, dataset_ids array<long>, expected_chunk_ids array<string>, expected_doc_ids array<long>, relevance_grades map<string,int>, golden_answer string, type string, note string"
HITS = "sample_id string, chunk_id string, doc_id long, dataset_id long, rank int, score double, sources array<string>"
ROUTE_HITS = "sample_id string, source string, route_rank int, chunk_id string, doc_id long, dataset_id long, score double"
RESPONSE = "sample_id string, hits array<struct<chunk_id:string,doc_id:long,dataset_id:long,fused_score:double,scores:map<string,double>>>, elapsed_ms int, per_source_counts map<string,int>, failed_sources array<string>"
DIAGNOSTICS = "sample_id string, type string, elapsed_ms int, per_source_counts map<string,int>, failed_sources array<string>, rerank_applied boolean, n_ranked int"
MANIFEST = "source_id string, doc_id long, status string"
COLLECTION = "source_id string, text string"
CHUNKS = "chunk_id string, dataset_id long, doc_id long, content string, content_hash string, ordinal int, char_len int, token_len int, dense_indexed boolean, sparse_indexed boolean, bm25_indexed boolean"
DATASETS = "dataset_id long, name string, source_type string, domain string, genre string, relevance_type string"
PAIRS = "sample_id string, fmt string, pdf_backend string, ref string, produced string, ok boolean, repeats array<string>, clean_ms long"
FACTS = "fact_id string, doc_id long, statement string, anchor string, section_hint string, answer string"
LAYERS = ("cleaning", "retrieval", "rerank", "generation", "correctness")
QUESTION_TYPES = ("keyword", "paraphrase", "longtail", "cross_doc")
