"""Training-data operators over ``documents``, ``pages`` and ``benchmark`` tables."""
