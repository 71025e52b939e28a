"""Analytics over trees of documents: chunking, hybrid retrieval, clustering, link graphs, journals, queues and logs."""
