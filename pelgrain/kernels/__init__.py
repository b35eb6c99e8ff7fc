"""Order-dependent algorithms on one image at a time, in numpy."""
