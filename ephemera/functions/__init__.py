"""Column functions: time scales, orbit mechanics, error vectors and cleaning."""
