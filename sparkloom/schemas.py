"""Schemas of nested inputs and of the model's tables. Every field is nullable; nothing is inferred."""

TURN = "struct<speaker:string,dia_id:string,text:string,img_url:string,blip_caption:string>"
QA = "struct<question:string,answer:string,evidence:array<string>,category:int,adversarial_answer:string>"
# the conversation has a key for each session: read as text, opened by sources.dataset
SAMPLE = f"struct<qa:array<{QA}>,conversation:map<string,string>,event_summary:map<string,map<string,array<string>>>,observation:map<string,map<string,array<array<string>>>>,session_summary:map<string,string>>"
DATASET = f"array<{SAMPLE}>"
RESULT = "struct<type:string,sample_id:string,question_id:int,question_id_in_sample:int,question:string,prediction:string,reference:string,category:string,metrics:map<string,double>,retrieved_nodes:array<string>>"

NODES = "sample_id string, node_id string, node_seq long, level string, content string, timestamp string, keywords array<string>, context string, tags array<string>, attribute_type string, refined boolean, attrs map<string,string>, version long"
EDGES = "sample_id string, src string, dst string, edge_seq long, type string, weight double, version long"
DOCS = "sample_id string, doc_seq long, node_id string, text string, version long"
EMBEDDINGS = "sample_id string, node_id string, vec array<float>"
#: Facts that have met those before them.
EVOLVED = "sample_id string, node_id string"

#: Key, Python type, annotator's reply.
ANNOTATION = "struct<keywords:array<string>,context:string,tags:array<string>>"
EVOLUTION = "struct<should_evolve:boolean,actions:array<string>,suggested_connections:array<string>,new_context_neighborhood:array<string>,new_tags_neighborhood:array<array<string>>>"
