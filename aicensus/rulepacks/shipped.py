"""The shipped rules: fixed values, stated as data. See ``operators.rules`` for their meaning."""

from __future__ import annotations

from ..operators.rules import RULE_LANGUAGES

# Rules on datasets.
DATASETS = [
    {"id": "datasets/load-dataset", "kind": "dataset", "provider": "huggingface", "confidence": 0.7,
     "languages": ["python"],
     "keywords": ["load_dataset"],
     "pattern": r'''\bload_dataset\s*\(\s*["'](?P<name>[\w./-]+)["']''',
     "claim": {"name": "${name}"}},
    {"id": "datasets/kagglehub", "kind": "dataset", "provider": "kaggle", "confidence": 0.7,
     "languages": ["python"],
     "keywords": ["kagglehub.dataset_download"],
     "pattern": r'''\bkagglehub\.dataset_download\s*\(\s*["'](?P<name>[\w.-]+/[\w.-]+)["']''',
     "claim": {"name": "${name}"}},
    {"id": "datasets/kaggle-cli", "kind": "dataset", "provider": "kaggle", "confidence": 0.7,
     "keywords": ["kaggle datasets download"],
     "pattern": r"kaggle\s+datasets\s+download\s+(?:-d\s+)?(?P<name>[\w.-]+/[\w.-]+)",
     "claim": {"name": "${name}"}},
]

# Rules on embeddings.
EMBEDDINGS = [
    {"id": "bge-e5/bge-literal", "kind": "embedding-model", "provider": "baai", "confidence": 0.85,
     "languages": RULE_LANGUAGES,
     "keywords": ["BAAI/bge-"],
     "pattern": r'''["'](?P<model>BAAI/bge-[\w.\-]+)["']''',
     "claim": {"name": "${model}"}},
    {"id": "bge-e5/e5-literal", "kind": "embedding-model", "provider": "intfloat", "confidence": 0.85,
     "languages": RULE_LANGUAGES,
     "keywords": ["intfloat/e5-", "multilingual-e5-"],
     "pattern": r'''["'](?P<model>(?:intfloat/)?(?:multilingual-e5-|e5-)[\w.\-]+)["']''',
     "claim": {"name": "${model}"}},
    {"id": "cohere-embed/model-literal", "kind": "embedding-model", "provider": "cohere", "confidence": 0.85,
     "languages": RULE_LANGUAGES,
     "keywords": ["embed-english", "embed-multilingual"],
     "pattern": r'''["'](?P<model>embed-(?:english|multilingual)[\w.\-]*)["']''',
     "claim": {"name": "${model}"}},
    {"id": "instructor/constructor", "kind": "embedding-model", "provider": "hkunlp", "confidence": 0.8,
     "languages": RULE_LANGUAGES,
     "keywords": ["INSTRUCTOR"],
     "pattern": r'''\bINSTRUCTOR\s*\(\s*["'](?P<model>[\w.\-/]+)["']''',
     "claim": {"name": "${model}"}},
    {"id": "instructor/model-literal", "kind": "embedding-model", "provider": "hkunlp", "confidence": 0.85,
     "languages": RULE_LANGUAGES,
     "keywords": ["hkunlp/instructor-"],
     "pattern": r'''["'](?P<model>hkunlp/instructor-[\w.\-]+)["']''',
     "claim": {"name": "${model}"}},
    {"id": "openai/embedding-literal", "kind": "embedding-model", "provider": "openai", "confidence": 0.85,
     "languages": RULE_LANGUAGES,
     "keywords": ["text-embedding-"],
     "pattern": r'''["'](?P<model>text-embedding-(?:3-(?:small|large)|ada-002)[\w.\-]*)["']''',
     "claim": {"name": "${model}"}},
    {"id": "sentence-transformers/constructor", "kind": "embedding-model", "provider": "sentence-transformers", "confidence": 0.85,
     "languages": RULE_LANGUAGES,
     "keywords": ["SentenceTransformer"],
     "pattern": r'''\bSentenceTransformer\s*\(\s*["'](?P<model>[\w.\-/]+)["']''',
     "claim": {"name": "${model}"}},
    {"id": "sentence-transformers/model-literal", "kind": "embedding-model", "provider": "sentence-transformers", "confidence": 0.8,
     "languages": RULE_LANGUAGES,
     "keywords": ["all-MiniLM", "all-mpnet", "all-distilroberta", "multi-qa-MiniLM"],
     "pattern": r'''["'](?P<model>(?:sentence-transformers/)?(?:all-MiniLM|all-mpnet|all-distilroberta|multi-qa-MiniLM)[\w.\-/]*)["']''',
     "claim": {"name": "${model}"}},
    {"id": "voyage/model-literal", "kind": "embedding-model", "provider": "voyage", "confidence": 0.85,
     "languages": RULE_LANGUAGES,
     "keywords": ["voyage-"],
     "pattern": r'''["'](?P<model>voyage-[\w.\-]+)["']''',
     "claim": {"name": "${model}"}},
    {"id": "voyage/embed-call", "kind": "library", "provider": "voyage", "confidence": 0.7,
     "languages": RULE_LANGUAGES,
     "keywords": ["voyageai", "vo.embed"],
     "regions": ["code"],
     "pattern": r"\bvoyageai\.Client\s*\(|\bvo\.embed\s*\(",
     "claim": {"name": "voyageai"}},
]

# Rules on frameworks.
FRAMEWORKS = [
    {"id": "autogen/import", "kind": "framework", "provider": "autogen", "confidence": 0.7,
     "languages": ["python"],
     "keywords": ["autogen", "pyautogen"],
     "regions": ["code"],
     "pattern": r"\b(?:import|from)\s+(?:pyautogen|autogen)[\w.]*",
     "claim": {"name": "autogen"}},
    {"id": "autogen/agent", "kind": "framework", "provider": "autogen", "confidence": 0.7,
     "languages": ["python"],
     "keywords": ["AssistantAgent", "UserProxyAgent"],
     "regions": ["code"],
     "pattern": r"\b(?:AssistantAgent|UserProxyAgent)\s*\(",
     "claim": {"name": "autogen"}},
    {"id": "crewai/import", "kind": "framework", "provider": "crewai", "confidence": 0.7,
     "languages": ["python"],
     "keywords": ["crewai"],
     "regions": ["code"],
     "pattern": r"\b(?:import|from)\s+crewai[\w.]*",
     "claim": {"name": "crewai"}},
    {"id": "crewai/construct", "kind": "framework", "provider": "crewai", "confidence": 0.7,
     "languages": ["python"],
     "keywords": ["Crew"],
     "regions": ["code"],
     "pattern": r"\bCrew\s*\(",
     "claim": {"name": "crewai"}},
    {"id": "dspy/import", "kind": "framework", "provider": "dspy", "confidence": 0.7,
     "languages": ["python"],
     "keywords": ["dspy"],
     "regions": ["code"],
     "pattern": r"\b(?:import|from)\s+dspy[\w.]*",
     "claim": {"name": "dspy"}},
    {"id": "dspy/module", "kind": "framework", "provider": "dspy", "confidence": 0.7,
     "languages": ["python"],
     "keywords": ["dspy.Predict", "dspy.ChainOfThought"],
     "regions": ["code"],
     "pattern": r"\bdspy\.(?:Predict|ChainOfThought)\s*\(",
     "claim": {"name": "dspy"}},
    {"id": "haystack/import", "kind": "framework", "provider": "haystack", "confidence": 0.7,
     "languages": ["python"],
     "keywords": ["haystack"],
     "regions": ["code"],
     "pattern": r"\b(?:import|from)\s+haystack[\w.]*",
     "claim": {"name": "haystack"}},
    {"id": "haystack/pipeline", "kind": "framework", "provider": "haystack", "confidence": 0.7,
     "languages": ["python"],
     "keywords": ["Pipeline"],
     "regions": ["code"],
     "pattern": r"\bPipeline\s*\(",
     "claim": {"name": "haystack"}},
    {"id": "langchain/import", "kind": "framework", "provider": "langchain", "confidence": 0.7,
     "languages": ["python", "javascript", "typescript"],
     "keywords": ["langchain", "@langchain/"],
     "pattern": r'''(?:\b(?:import|from)\s+langchain[\w.]*|["']@?langchain(?:/[\w.-]+)*["'])''',
     "claim": {"name": "langchain"}},
    {"id": "langchain/client-construct", "kind": "framework", "provider": "langchain", "confidence": 0.7,
     "languages": ["python", "javascript", "typescript"],
     "keywords": ["ChatOpenAI", "LLMChain"],
     "regions": ["code"],
     "pattern": r"\b(?:ChatOpenAI|LLMChain)\s*\(",
     "claim": {"name": "langchain"}},
    {"id": "llamaindex/import", "kind": "framework", "provider": "llama-index", "confidence": 0.7,
     "languages": ["python", "javascript", "typescript"],
     "keywords": ["llama_index", "llamaindex"],
     "pattern": r'''(?:\b(?:import|from)\s+llama_index[\w.]*|["']llamaindex(?:/[\w.-]+)*["'])''',
     "claim": {"name": "llama-index"}},
    {"id": "llamaindex/index-construct", "kind": "framework", "provider": "llama-index", "confidence": 0.7,
     "languages": ["python", "javascript", "typescript"],
     "keywords": ["VectorStoreIndex", "ServiceContext"],
     "regions": ["code"],
     "pattern": r"\b(?:VectorStoreIndex|ServiceContext)\s*[.(]",
     "claim": {"name": "llama-index"}},
    {"id": "mlflow/import", "kind": "library", "provider": "mlflow", "confidence": 0.7,
     "languages": ["python"],
     "keywords": ["mlflow"],
     "regions": ["code"],
     "pattern": r"\b(?:import|from)\s+mlflow[\w.]*",
     "claim": {"name": "mlflow"}},
    {"id": "mlflow/flavor-logmodel", "kind": "library", "provider": "mlflow", "confidence": 0.7,
     "languages": ["python"],
     "keywords": ["log_model", "autolog"],
     "regions": ["code"],
     "pattern": r"\bmlflow\.(?:openai|langchain|transformers|pyfunc|sklearn|pytorch|onnx|xgboost)\.(?:log_model|autolog)\s*\(",
     "claim": {"name": "mlflow"}},
    {"id": "semantic-kernel/import", "kind": "framework", "provider": "semantic-kernel", "confidence": 0.7,
     "languages": ["python", "csharp"],
     "keywords": ["semantic_kernel", "Microsoft.SemanticKernel"],
     "regions": ["code"],
     "pattern": r"(?:\b(?:import|from)\s+semantic_kernel[\w.]*|\busing\s+Microsoft\.SemanticKernel[\w.]*)",
     "claim": {"name": "semantic-kernel"}},
    {"id": "semantic-kernel/kernel-builder", "kind": "framework", "provider": "semantic-kernel", "confidence": 0.7,
     "languages": ["csharp"],
     "keywords": ["Kernel.CreateBuilder"],
     "regions": ["code"],
     "pattern": r"\bKernel\.CreateBuilder\s*\(",
     "claim": {"name": "semantic-kernel"}},
    {"id": "transformers/import", "kind": "library", "provider": "huggingface", "confidence": 0.7,
     "languages": ["python"],
     "keywords": ["transformers"],
     "regions": ["code"],
     "pattern": r"\b(?:import|from)\s+transformers[\w.]*",
     "claim": {"name": "transformers"}},
    {"id": "transformers/auto-class", "kind": "library", "provider": "huggingface", "confidence": 0.7,
     "languages": ["python"],
     "keywords": ["AutoModel", "AutoTokenizer", "pipeline"],
     "regions": ["code"],
     "pattern": r"(?:\bAuto(?:Model|Tokenizer|Config|FeatureExtractor|Processor)\w*\.from_pretrained\s*\(|\bpipeline\s*\()",
     "claim": {"name": "transformers"}},
    {"id": "vllm/import", "kind": "library", "provider": "vllm", "confidence": 0.7,
     "languages": ["python"],
     "keywords": ["vllm"],
     "regions": ["code"],
     "pattern": r"\b(?:import|from)\s+vllm[\w.]*",
     "claim": {"name": "vllm"}},
    {"id": "vllm/llm-construct", "kind": "library", "provider": "vllm", "confidence": 0.7,
     "languages": ["python"],
     "keywords": ["SamplingParams"],
     "regions": ["code"],
     "pattern": r"\b(?:LLM|SamplingParams)\s*\(",
     "claim": {"name": "vllm"}},
]

# Rules on infra.
INFRA = [
    {"id": "azureml/import", "kind": "service", "provider": "azure-ml", "confidence": 0.7,
     "languages": ["python"],
     "keywords": ["azureml", "azure.ai.ml"],
     "regions": ["code"],
     "pattern": r"(?:\b(?:import|from)\s+azureml[\w.]*|\b(?:import|from)\s+azure\.ai\.ml[\w.]*|\bfrom\s+azure\.ai\.ml\b)",
     "claim": {"name": "azure-ml"}},
    {"id": "azureml/mlclient", "kind": "service", "provider": "azure-ml", "confidence": 0.7,
     "languages": ["python"],
     "keywords": ["MLClient"],
     "regions": ["code"],
     "pattern": r"\bMLClient\s*\(",
     "claim": {"name": "azure-ml"}},
    {"id": "inference-endpoints/client", "kind": "service", "provider": "huggingface", "confidence": 0.7,
     "languages": ["python", "javascript", "typescript"],
     "keywords": ["InferenceClient"],
     "regions": ["code"],
     "pattern": r"\bInferenceClient\s*\(",
     "claim": {"name": "hf-inference-endpoints"}},
    {"id": "inference-endpoints/api-host", "kind": "service", "provider": "huggingface", "confidence": 0.7,
     "keywords": ["api-inference.huggingface.co"],
     "pattern": r"\bapi-inference\.huggingface\.co\b",
     "claim": {"name": "hf-inference-endpoints"}},
    {"id": "ollama/import", "kind": "infra", "provider": "ollama", "confidence": 0.7,
     "languages": ["python", "javascript", "typescript", "go"],
     "keywords": ["ollama"],
     "pattern": r'''(?:\b(?:import|from)\s+ollama[\w.]*|["']ollama["']|["']github\.com/ollama/[\w./-]+["'])''',
     "claim": {"name": "ollama"}},
    {"id": "ollama/serve-endpoint", "kind": "infra", "provider": "ollama", "confidence": 0.7,
     "keywords": ["OLLAMA_HOST", "11434", "ollama serve"],
     "pattern": r"(?:\bOLLAMA_HOST\b|localhost:11434|127\.0\.0\.1:11434|\bollama\s+serve\b)",
     "claim": {"name": "ollama"}},
    {"id": "ollama/client", "kind": "infra", "provider": "ollama", "confidence": 0.7,
     "languages": ["python", "javascript", "typescript"],
     "keywords": ["ollama.Client", "ollama.chat", "ollama.AsyncClient", "ollama.generate"],
     "regions": ["code"],
     "pattern": r"\bollama\.(?:Client|AsyncClient|chat|generate)\s*\(",
     "claim": {"name": "ollama"}},
    {"id": "rayserve/import", "kind": "infra", "provider": "ray", "confidence": 0.7,
     "languages": ["python"],
     "keywords": ["ray import serve"],
     "regions": ["code"],
     "pattern": r"\bfrom\s+ray\s+import\s+serve\b",
     "claim": {"name": "ray-serve"}},
    {"id": "rayserve/deployment", "kind": "infra", "provider": "ray", "confidence": 0.7,
     "languages": ["python"],
     "keywords": ["@serve.deployment", "serve.deployment"],
     "regions": ["code"],
     "pattern": r"@serve\.deployment\b",
     "claim": {"name": "ray-serve"}},
    {"id": "sagemaker/import", "kind": "service", "provider": "aws-sagemaker", "confidence": 0.7,
     "languages": ["python"],
     "keywords": ["sagemaker"],
     "regions": ["code"],
     "pattern": r"\b(?:import|from)\s+sagemaker[\w.]*",
     "claim": {"name": "sagemaker"}},
    {"id": "sagemaker/runtime", "kind": "service", "provider": "aws-sagemaker", "confidence": 0.7,
     "languages": ["python"],
     "keywords": ["sagemaker-runtime", "invoke_endpoint"],
     "pattern": r'''(?:["']sagemaker-runtime["']|\.invoke_endpoint\s*\()''',
     "claim": {"name": "sagemaker"}},
    {"id": "tgi/reference", "kind": "infra", "provider": "huggingface", "confidence": 0.7,
     "keywords": ["text-generation-inference"],
     "pattern": r"\btext-generation-inference\b",
     "claim": {"name": "text-generation-inference"}},
    {"id": "tgi/launcher", "kind": "infra", "provider": "huggingface", "confidence": 0.7,
     "keywords": ["text-generation-launcher"],
     "pattern": r"\btext-generation-launcher\b",
     "claim": {"name": "text-generation-inference"}},
    {"id": "vertex/import", "kind": "service", "provider": "gcp-vertex", "confidence": 0.7,
     "languages": ["python"],
     "keywords": ["vertexai", "aiplatform"],
     "regions": ["code"],
     "pattern": r"(?:\b(?:import|from)\s+vertexai[\w.]*|\bfrom\s+google\.cloud\s+import\s+aiplatform\b|\b(?:import|from)\s+google\.cloud\.aiplatform[\w.]*)",
     "claim": {"name": "vertex-ai"}},
    {"id": "vertex/endpoint", "kind": "service", "provider": "gcp-vertex", "confidence": 0.7,
     "languages": ["python"],
     "keywords": ["aiplatform.Endpoint"],
     "regions": ["code"],
     "pattern": r"\baiplatform\.Endpoint\s*\(",
     "claim": {"name": "vertex-ai"}},
    {"id": "vllm/serve", "kind": "infra", "provider": "vllm", "confidence": 0.7,
     "keywords": ["vllm serve"],
     "pattern": r"\bvllm\s+serve\b",
     "claim": {"name": "vllm"}},
    {"id": "vllm/api-server", "kind": "infra", "provider": "vllm", "confidence": 0.7,
     "keywords": ["vllm.entrypoints.openai.api_server"],
     "pattern": r"\bvllm\.entrypoints\.openai\.api_server\b",
     "claim": {"name": "vllm"}},
    {"id": "vllm/served-model-name", "kind": "infra", "provider": "vllm", "confidence": 0.7,
     "keywords": ["--served-model-name"],
     "pattern": r"--served-model-name\b",
     "claim": {"name": "vllm"}},
]

# Rules on models.
MODELS = [
    {"id": "anthropic/model-literal", "kind": "hosted-llm", "provider": "anthropic", "confidence": 0.85,
     "languages": RULE_LANGUAGES,
     "keywords": ["claude-"],
     "pattern": r'''\b(?i:[a-z0-9_]*model[a-z0-9_]*)["']?\s*[:=]\s*["'](?P<model>claude-[\w.\-:]+)["']''',
     "claim": {"name": "${model}"}},
    {"id": "anthropic/messages-call", "kind": "library", "provider": "anthropic", "confidence": 0.7,
     "languages": RULE_LANGUAGES,
     "keywords": ["messages.create"],
     "regions": ["code"],
     "pattern": r"\.messages\.create\s*\(",
     "claim": {"name": "anthropic"},
     "relations": [{"type": "uses", "target_kind": "hosted-llm", "from_field": "model"}],
     "within_lines": 12,
     "param_names": ["temperature", "top_p", "top_k", "max_tokens", "stop_sequences", "stop", "response_format"]},
    {"id": "azure-openai/deployment-literal", "kind": "hosted-llm", "provider": "azure-openai", "confidence": 0.8,
     "languages": RULE_LANGUAGES,
     "keywords": ["azure_deployment", "deployment_name", "deployment_id", "azureDeployment"],
     "pattern": r'''\b(?:azure_deployment|deployment_name|deployment_id|azureDeployment)["']?\s*[:=]\s*["'](?P<deployment>[\w.\-]+)["']''',
     "claim": {"name": "${deployment}"}},
    {"id": "azure-openai/client-construct", "kind": "library", "provider": "azure-openai", "confidence": 0.7,
     "languages": RULE_LANGUAGES,
     "keywords": ["AzureOpenAI", "AzureChatOpenAI"],
     "regions": ["code"],
     "pattern": r"\b(?:AzureOpenAI|AzureChatOpenAI)\s*\(",
     "claim": {"name": "azure-openai-sdk"}},
    {"id": "bedrock/model-literal", "kind": "hosted-llm", "provider": "aws-bedrock", "confidence": 0.85,
     "languages": RULE_LANGUAGES,
     "keywords": ["anthropic.claude", "amazon.titan", "amazon.nova", "meta.llama", "mistral.", "cohere.command", "ai21."],
     "pattern": r'''["'](?P<model>(?:(?:us|eu|apac)\.)?(?:anthropic|amazon|meta|mistral|cohere|ai21)\.[\w.\-:]+)["']''',
     "claim": {"name": "${model}"}},
    {"id": "bedrock/runtime-call", "kind": "library", "provider": "aws-bedrock", "confidence": 0.7,
     "languages": RULE_LANGUAGES,
     "keywords": ["invoke_model", "InvokeModel", "bedrock-runtime"],
     "pattern": r'''(?:\.invoke_model\s*\(|InvokeModelCommand|["']bedrock-runtime["'])''',
     "claim": {"name": "bedrock-runtime"}},
    {"id": "cohere/model-literal", "kind": "hosted-llm", "provider": "cohere", "confidence": 0.85,
     "languages": RULE_LANGUAGES,
     "keywords": ["command-r", "command-light", "command-nightly", "command-a", "command"],
     "pattern": r'''\b(?i:[a-z0-9_]*model[a-z0-9_]*)["']?\s*[:=]\s*["'](?P<model>command(?:-(?:r(?:-plus)?|r7b|a|light|nightly)(?:-[\w.\-]+)?)?)["']''',
     "claim": {"name": "${model}"}},
    {"id": "cohere/sdk-call", "kind": "library", "provider": "cohere", "confidence": 0.7,
     "languages": RULE_LANGUAGES,
     "keywords": ["cohere.Client", ".chat("],
     "regions": ["code"],
     "pattern": r"\bcohere\.Client(?:V2)?\s*\(|\bco\.chat\s*\(",
     "claim": {"name": "cohere"}},
    {"id": "gemini/model-literal", "kind": "hosted-llm", "provider": "google", "confidence": 0.85,
     "languages": RULE_LANGUAGES,
     "keywords": ["gemini-"],
     "pattern": r'''["'](?P<model>(?:models/)?gemini-[\w.\-]+)["']''',
     "claim": {"name": "${model}"}},
    {"id": "gemini/sdk-call", "kind": "library", "provider": "google", "confidence": 0.7,
     "languages": RULE_LANGUAGES,
     "keywords": ["GenerativeModel", "generate_content", "generateContent"],
     "regions": ["code"],
     "pattern": r"\b(?:GenerativeModel|generate_content|generateContent)\s*\(",
     "claim": {"name": "google-genai"}},
    {"id": "groq/client-construct", "kind": "library", "provider": "groq", "confidence": 0.7,
     "languages": RULE_LANGUAGES,
     "keywords": ["Groq", "ChatGroq", "AsyncGroq"],
     "regions": ["code"],
     "pattern": r"\b(?:Groq|ChatGroq|AsyncGroq)\s*\(",
     "claim": {"name": "groq"}},
    {"id": "groq/model-literal", "kind": "hosted-llm", "provider": "groq", "confidence": 0.8,
     "languages": RULE_LANGUAGES,
     "keywords": ["-versatile", "-instant"],
     "pattern": r'''\b(?i:[a-z0-9_]*model[a-z0-9_]*)["']?\s*[:=]\s*["'](?P<model>(?:llama|gemma|mixtral|qwen|deepseek)[\w.\-]*-(?:versatile|instant))["']''',
     "claim": {"name": "${model}"}},
    {"id": "huggingface/from-pretrained", "kind": "hosted-llm", "provider": "huggingface", "confidence": 0.85,
     "languages": RULE_LANGUAGES,
     "keywords": ["from_pretrained"],
     "pattern": r'''\.from_pretrained\s*\(\s*["'](?P<model>[\w.\-]+/[\w.\-]+)["']''',
     "claim": {"name": "${model}"}},
    {"id": "huggingface/pipeline", "kind": "library", "provider": "huggingface", "confidence": 0.6,
     "languages": RULE_LANGUAGES,
     "keywords": ["pipeline("],
     "pattern": r'''\bpipeline\s*\(\s*["']''',
     "claim": {"name": "transformers"}},
    {"id": "mistral/model-literal", "kind": "hosted-llm", "provider": "mistral", "confidence": 0.85,
     "languages": RULE_LANGUAGES,
     "keywords": ["mistral-", "mixtral-", "codestral-", "ministral-", "magistral-", "pixtral-", "devstral-"],
     "pattern": r'''\b(?i:[a-z0-9_]*model[a-z0-9_]*)["']?\s*[:=]\s*["'](?P<model>(?:open-mistral-|open-mixtral-|mistral-|mixtral-|codestral-|ministral-|magistral-|pixtral-|devstral-)[\w.\-]+)["']''',
     "claim": {"name": "${model}"}},
    {"id": "mistral/sdk-call", "kind": "library", "provider": "mistral", "confidence": 0.7,
     "languages": RULE_LANGUAGES,
     "keywords": ["chat.complete", "mistralai"],
     "pattern": r'''\.chat\.complete(?:_async|_stream)?\s*\(|["']mistralai["']''',
     "claim": {"name": "mistralai"}},
    {"id": "ollama/sdk-call", "kind": "library", "provider": "ollama", "confidence": 0.7,
     "languages": RULE_LANGUAGES,
     "keywords": ["ollama.chat", "ollama.generate", "ollama.embeddings", "ollama.pull"],
     "regions": ["code"],
     "pattern": r"\bollama\.(?:chat|generate|embeddings|pull|show|list)\s*\(",
     "claim": {"name": "ollama"},
     "relations": [{"type": "uses", "target_kind": "hosted-llm", "from_field": "model"}],
     "within_lines": 12,
     "param_names": ["temperature", "top_p", "top_k", "num_predict", "num_ctx", "seed", "stop", "format"]},
    {"id": "ollama/run-command", "kind": "hosted-llm", "provider": "ollama", "confidence": 0.75,
     "languages": RULE_LANGUAGES,
     "keywords": ["ollama run"],
     "pattern": r"\bollama\s+run\s+(?P<model>[a-z0-9][\w.\-:/]*)",
     "claim": {"name": "${model}"}},
    {"id": "openai/model-literal", "kind": "hosted-llm", "provider": "openai", "confidence": 0.85,
     "languages": RULE_LANGUAGES,
     "keywords": ["gpt-", "chatgpt-", "o1", "o3", "o4"],
     "pattern": r'''\b(?i:[a-z0-9_]*model[a-z0-9_]*)["']?\s*[:=]\s*["'](?P<model>(?:gpt-|chatgpt-)[\w.\-]+|o[134](?:[.-][\w.\-]+)?)["']''',
     "claim": {"name": "${model}"}},
    {"id": "openai/chat-call", "kind": "library", "provider": "openai", "confidence": 0.7,
     "languages": RULE_LANGUAGES,
     "keywords": ["chat.completions.create", "responses.create"],
     "regions": ["code"],
     "pattern": r"\.(?:chat\.completions|responses)\.create\s*\(",
     "claim": {"name": "openai"},
     "relations": [{"type": "uses", "target_kind": "hosted-llm", "from_field": "model"}],
     "within_lines": 12,
     "param_names": ["temperature", "top_p", "top_k", "max_tokens", "max_output_tokens", "seed", "stop", "reasoning_effort", "response_format"]},
]

# Rules on params.
PARAMS = [
    {"id": "aiconfig/sampling", "kind": "ai-config", "provider": "", "confidence": 0.5,
     "keywords": ["temperature", "top_p", "top_k"],
     "pattern": r'''(?m)^[ \t]*["']?(?P<param>temperature|top_p|top_k)["']?\s*[:=]\s*[0-9]''',
     "claim": {"name": "${param}"}},
    {"id": "aiconfig/token-limits", "kind": "ai-config", "provider": "", "confidence": 0.5,
     "keywords": ["max_tokens", "max_output_tokens", "max_new_tokens", "context_length", "context_window", "max_context_length", "n_ctx", "num_ctx"],
     "pattern": r'''(?m)^[ \t]*["']?(?P<param>max_tokens|max_output_tokens|max_new_tokens|context_length|context_window|max_context_length|n_ctx|num_ctx)["']?\s*[:=]\s*[0-9]''',
     "claim": {"name": "${param}"}},
    {"id": "aiconfig/decoding", "kind": "ai-config", "provider": "", "confidence": 0.5,
     "keywords": ["reasoning_effort", "response_format"],
     "pattern": r'''(?m)^[ \t]*["']?(?P<param>reasoning_effort|response_format)["']?\s*[:=]\s*\S''',
     "claim": {"name": "${param}"}},
    {"id": "training/optimization", "kind": "ai-config", "provider": "", "confidence": 0.5,
     "keywords": ["learning_rate_multiplier", "learning_rate", "weight_decay", "max_grad_norm", "adam_epsilon"],
     "pattern": r'''(?m)^[ \t]*["']?(?P<param>learning_rate_multiplier|learning_rate|weight_decay|max_grad_norm|adam_epsilon)["']?\s*[:=]\s*[0-9]''',
     "claim": {"name": "${param}"}},
    {"id": "training/schedule", "kind": "ai-config", "provider": "", "confidence": 0.5,
     "keywords": ["num_train_epochs", "n_epochs", "warmup_ratio", "gradient_accumulation_steps", "per_device_train_batch_size"],
     "pattern": r'''(?m)^[ \t]*["']?(?P<param>num_train_epochs|n_epochs|warmup_ratio|gradient_accumulation_steps|per_device_train_batch_size)["']?\s*[:=]\s*[0-9]''',
     "claim": {"name": "${param}"}},
]

# Rules on prompts.
PROMPTS = [
    {"id": "prompts/langchain-template", "kind": "prompt", "provider": "", "confidence": 0.6,
     "languages": ["python", "javascript", "typescript"],
     "keywords": ["PromptTemplate"],
     "regions": ["code"],
     "pattern": r"\b(?:Chat)?PromptTemplate(?:\.\w+)?\s*\(",
     "claim": {"name": "prompt-template"}},
    {"id": "prompts/system-message", "kind": "prompt", "provider": "", "confidence": 0.6,
     "languages": ["python", "javascript", "typescript"],
     "keywords": ["SystemMessage", "system_prompt", "SYSTEM_PROMPT"],
     "regions": ["code"],
     "pattern": r"(?:\bSystemMessage\s*\(|\b(?:system_prompt|SYSTEM_PROMPT)\s*=)",
     "claim": {"name": "system-prompt"}},
    {"id": "prompts/jinja-var", "kind": "prompt", "provider": "", "confidence": 0.6,
     "languages": ["python", "javascript", "typescript"],
     "keywords": ["{{"],
     "pattern": r'''\b\w*[Pp]rompt\w*\s*=\s*(?:f|r|fr|rf)?["'][^"'\n]*\{\{''',
     "claim": {"name": "prompt-template"}},
]

# Rules on security.
SECURITY = [
    {"id": "unsafe-load/torch-weights-only-false", "kind": "library", "provider": "pytorch", "confidence": 0.8,
     "languages": ["python"],
     "keywords": ["torch.load"],
     "regions": ["code"],
     "pattern": r"\btorch\.load\s*\((?:[^()]|\([^()]*\))*\bweights_only\s*=\s*False\b",
     "claim": {"name": "torch"},
     "risk": "RISK-UNSAFE-LOAD"},
]

# Rules on vectordb.
VECTORDB = [
    {"id": "chroma/import", "kind": "vector-db", "provider": "chroma", "confidence": 0.7,
     "languages": ["python"],
     "keywords": ["chromadb"],
     "regions": ["code"],
     "pattern": r"\b(?:import|from)\s+chromadb[\w.]*",
     "claim": {"name": "chroma"}},
    {"id": "chroma/client", "kind": "vector-db", "provider": "chroma", "confidence": 0.7,
     "languages": ["python"],
     "keywords": ["chromadb.Client", "chromadb.PersistentClient", "chromadb.HttpClient"],
     "regions": ["code"],
     "pattern": r"\bchromadb\.(?:Client|PersistentClient|HttpClient|EphemeralClient)\s*\(",
     "claim": {"name": "chroma"}},
    {"id": "elastic-vector/dense-vector", "kind": "vector-db", "provider": "elastic", "confidence": 0.7,
     "languages": ["python", "javascript", "typescript", "go", "java"],
     "keywords": ["dense_vector"],
     "pattern": r'''["']dense_vector["']''',
     "claim": {"name": "elasticsearch"}},
    {"id": "elastic-vector/knn-search", "kind": "vector-db", "provider": "elastic", "confidence": 0.7,
     "languages": ["python", "javascript", "typescript", "go", "java"],
     "keywords": ["query_vector"],
     "pattern": r'''["']query_vector["']\s*:''',
     "claim": {"name": "elasticsearch"}},
    {"id": "faiss/import", "kind": "vector-db", "provider": "faiss", "confidence": 0.7,
     "languages": ["python"],
     "keywords": ["faiss"],
     "regions": ["code"],
     "pattern": r"\b(?:import|from)\s+faiss[\w.]*",
     "claim": {"name": "faiss"}},
    {"id": "faiss/index", "kind": "vector-db", "provider": "faiss", "confidence": 0.7,
     "languages": ["python"],
     "keywords": ["IndexFlat", "faiss.write_index", "faiss.read_index"],
     "regions": ["code"],
     "pattern": r"(?:\bfaiss\.Index\w+\s*\(|\bfaiss\.(?:write_index|read_index)\s*\()",
     "claim": {"name": "faiss"}},
    {"id": "milvus/import", "kind": "vector-db", "provider": "milvus", "confidence": 0.7,
     "languages": ["python"],
     "keywords": ["pymilvus"],
     "regions": ["code"],
     "pattern": r"\b(?:import|from)\s+pymilvus[\w.]*",
     "claim": {"name": "milvus"}},
    {"id": "milvus/connect", "kind": "vector-db", "provider": "milvus", "confidence": 0.7,
     "languages": ["python"],
     "keywords": ["connections.connect", "MilvusClient"],
     "regions": ["code"],
     "pattern": r"(?:\bconnections\.connect\s*\(|\bMilvusClient\s*\()",
     "claim": {"name": "milvus"}},
    {"id": "mongodb-atlas/vector-search", "kind": "vector-db", "provider": "mongodb", "confidence": 0.7,
     "languages": ["python", "javascript", "typescript", "go", "java", "csharp"],
     "keywords": ["$vectorSearch"],
     "pattern": r'''["']\$vectorSearch["']''',
     "claim": {"name": "mongodb-atlas"}},
    {"id": "mongodb-atlas/vector-index", "kind": "vector-db", "provider": "mongodb", "confidence": 0.7,
     "languages": ["python", "javascript", "typescript", "go", "java", "csharp"],
     "keywords": ["numDimensions"],
     "pattern": r'''["']numDimensions["']\s*:''',
     "claim": {"name": "mongodb-atlas"}},
    {"id": "pgvector/create-extension", "kind": "vector-db", "provider": "pgvector", "confidence": 0.7,
     "keywords": ["CREATE EXTENSION", "create extension"],
     "pattern": r'(?i)create\s+extension\s+(?:if\s+not\s+exists\s+)?"?vector"?',
     "claim": {"name": "pgvector"}},
    {"id": "pgvector/vector-column", "kind": "vector-db", "provider": "pgvector", "confidence": 0.7,
     "keywords": ["vector("],
     "pattern": r"\bvector\s*\(\s*\d+\s*\)",
     "claim": {"name": "pgvector"}},
    {"id": "pgvector/distance-op", "kind": "vector-db", "provider": "pgvector", "confidence": 0.6,
     "keywords": ["<->", "<=>", "<#>"],
     "pattern": r"<(?:->|=>|#>)",
     "claim": {"name": "pgvector"}},
    {"id": "pinecone/import", "kind": "vector-db", "provider": "pinecone", "confidence": 0.7,
     "languages": ["python", "javascript", "typescript"],
     "keywords": ["pinecone", "@pinecone-database/"],
     "pattern": r'''(?:\b(?:import|from)\s+pinecone[\w.]*|["']@pinecone-database/[\w.-]+["'])''',
     "claim": {"name": "pinecone"}},
    {"id": "pinecone/client", "kind": "vector-db", "provider": "pinecone", "confidence": 0.7,
     "languages": ["python", "javascript", "typescript"],
     "keywords": ["Pinecone", "pinecone.Index"],
     "regions": ["code"],
     "pattern": r"(?:\bPinecone\s*\(|\bpinecone\.Index\s*\()",
     "claim": {"name": "pinecone"}},
    {"id": "qdrant/import", "kind": "vector-db", "provider": "qdrant", "confidence": 0.7,
     "languages": ["python", "javascript", "typescript"],
     "keywords": ["qdrant_client", "@qdrant/"],
     "pattern": r'''(?:\b(?:import|from)\s+qdrant_client[\w.]*|["']@qdrant/[\w.-]+["'])''',
     "claim": {"name": "qdrant"}},
    {"id": "qdrant/client", "kind": "vector-db", "provider": "qdrant", "confidence": 0.7,
     "languages": ["python", "javascript", "typescript"],
     "keywords": ["QdrantClient"],
     "regions": ["code"],
     "pattern": r"\bQdrantClient\s*\(",
     "claim": {"name": "qdrant"}},
    {"id": "redis-vector/vectorfield", "kind": "vector-db", "provider": "redis", "confidence": 0.7,
     "languages": ["python"],
     "keywords": ["VectorField"],
     "regions": ["code"],
     "pattern": r"\bVectorField\s*\(",
     "claim": {"name": "redis"}},
    {"id": "redis-vector/ft-create", "kind": "vector-db", "provider": "redis", "confidence": 0.7,
     "languages": ["python", "javascript", "typescript", "go", "java"],
     "keywords": ["FT.CREATE"],
     "pattern": r"FT\.CREATE\b[^\n]*\bVECTOR\b",
     "claim": {"name": "redis"}},
    {"id": "weaviate/import", "kind": "vector-db", "provider": "weaviate", "confidence": 0.7,
     "languages": ["python", "javascript", "typescript"],
     "keywords": ["weaviate"],
     "pattern": r'''(?:\b(?:import|from)\s+weaviate[\w.]*|["']weaviate-[\w.-]+["'])''',
     "claim": {"name": "weaviate"}},
    {"id": "weaviate/client", "kind": "vector-db", "provider": "weaviate", "confidence": 0.7,
     "languages": ["python"],
     "keywords": ["weaviate.Client", "weaviate.connect_to_"],
     "regions": ["code"],
     "pattern": r"(?:\bweaviate\.Client\s*\(|\bweaviate\.connect_to_\w+\s*\()",
     "claim": {"name": "weaviate"}},
]

SHIPPED = [*DATASETS, *EMBEDDINGS, *FRAMEWORKS, *INFRA, *MODELS, *PARAMS, *PROMPTS, *SECURITY, *VECTORDB]
