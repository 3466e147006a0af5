"""tidelog: Spark-native analytics for CDN and video-streaming access logs."""
