"""Declared schemas of the tables that the engine reads and writes."""

CORPUS = "doc_id string, title string, text string"
QUERIES = "query_id string, text string"
QRELS = "query_id string, doc_id string, score int"
VECTORS = "vec_id long, embedding array<float>"
CODES = "vec_id long, codes array<int>"
CODEBOOK = "m int, code int, centroid array<double>"
POSTINGS = "list_id int, vec_id long, codes array<int>"
COARSE = "list_id int, centroid array<double>"
RANKING = "query_id long, rank long, vec_id long, score double"
SAMPLES = "endpoint string, batch_size int, run int, client_latency_ms double, server_latency_ms double, returned_items int"
RESULT = (
    "method string, retrieval_mode string, index_type string, nlist int, nprobe int, m int, k int, bits int, vectors long, dimension int, payload_bytes long, "
    "codebook_bytes long, transform_bytes long, format_bytes long, deployment_bytes long, serialized_bytes long, payload_ratio double, format_ratio double, "
    "deployment_ratio double, serialized_ratio double, recall_at_5 double, recall_at_10 double, success_at_10 double, mrr_at_10 double, ndcg_at_10 double, overlap_at_10 double, mse double, "
    "mean_cosine double, p50_ms double, p95_ms double, mean_ms double, queries_per_second double, timed_queries long"
)
