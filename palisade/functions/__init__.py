"""Column functions: text primitives, decoders, Unicode clean-up."""
