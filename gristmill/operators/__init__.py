"""DataFrame operators: motifs, windows, actions, requests, embedding, models, evaluation."""
