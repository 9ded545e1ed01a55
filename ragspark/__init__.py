"""ragspark: DataFrame pipelines for retrieval-augmented question answering and corpus curation."""
