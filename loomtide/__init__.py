"""loomtide: a Spark-first engine for preparing images, text, tensors, video and annotated objects for training."""
