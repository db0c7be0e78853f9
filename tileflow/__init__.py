"""tileflow: Spark jobs over the outputs of image-recognition models."""
