"""DataFrame operators: frames, sources, outcomes, metrics, dataset joins, patches, transcripts, prompts."""
