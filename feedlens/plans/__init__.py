"""The ready-made queries: weekly digest, trending repositories, topic search."""
