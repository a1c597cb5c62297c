"""The live form: segments as they are recognised, files as they arrive."""
