"""The one stream of the project is the job ``jobs.index_documents``; no operator is a stream."""
